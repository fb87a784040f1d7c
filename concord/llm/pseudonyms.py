"""Format-preserving pseudonyms for personal data, in Spark SQL expressions only.

Values are found by one pattern a text, validated, and permuted within their format by a keyed Feistel network, so a
value has the same pseudonym in every document, two values never share one, and the pseudonym is valid itself:

* e-mail addresses: the local part, letter by letter and digit by digit (the domain stays);
* payment card numbers (13-19 digits with a right check digit, blanks or hyphens allowed): all digits but the
  last are permuted, the check digit is computed anew. Numbers with a wrong check digit are no cards and stay, but
  the shorter and later groups in them are tried: the usual layouts (one group, 4-4-4-4, 4-6-5, 4-6-4, 4-4-4-4-3)
  at any place, then other groupings (of three digits or more, but for the last group);
* IBANs (right modulo 97, tried to the end of each group; the country's length goes first): country and form stay,
  check digits are computed anew;
* IPv4 addresses (four numbers to 255): permuted among all of them;
* dates from 1900 to 2099 (``yyyy-mm-dd`` or ``dd.mm.yyyy``, also with ``/`` or ``-``; month first where only
  that is a date): permuted among the days of these years. Others are left;
* social security numbers (valid area, group and serial): permuted among the valid ones;
* phone numbers (international, or three groups): the digits after the country code. A following address, date or
  card is not part of it, nor is a number behind a blank where the country has a fixed length or the groups before
  are joined by dots or hyphens; in other countries a short number behind a blank cannot be told from a group;
* hexadecimal secrets of 32 to 64 digits: digits among digits, letters among a-f.

Digit strings and texts are halved; each round adds a keyed hash of one half to the other, character by
character within 0-9, a-z or A-Z. Numbers use the same rounds on two remainders whose ranges multiply to the
size of the format, so the permutation never leaves it.

Null texts stay null, empty and clean texts stay as they are; whole texts are read, whatever their length.
The default key is for tests: keep the real one secret, as it reverses the pseudonyms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
FIRST_DAY, DAYS = "1900-01-01", 73049  # 17 * 4297 days to the end of 2099

# possessive and guarded on the left, so a long run without a match is read once
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.)+[A-Za-z]{2,24}+"
HEX = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])"
_MIDDLE = r"(?:-[0-9]{2}-|\.[0-9]{2}\.|/[0-9]{2}/)"
DATE = rf"(?<![0-9])(?:[0-9]{{4}}{_MIDDLE}[0-9]{{2}}|[0-9]{{2}}{_MIDDLE}[0-9]{{4}})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# check digits are no matter of patterns: these find candidates, of which the valid ones enter the pattern of their text
GUARDED = r"(?<![0-9A-Za-z])(?:%s)(?![0-9A-Za-z])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
CARD_LAYOUT = "|".join([r"[0-9]{13,19}", *(s.join(f"[0-9]{{{n}}}" for n in sizes) for sizes in ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4)) for s in " -")])
LONG_LAYOUT = "|".join(s.join(f"[0-9]{{{n}}}" for n in (4, 4, 4, 4, 3)) for s in " -")
CARD_GROUPS = r"[0-9]{3,16}(?:[ -][0-9]{3,16}){0,5}(?:[ -][0-9]{1,16})?"

# a group that begins another value, or more digits than a phone number has left, does not belong to it
_OWN = f"(?!{IP}|{DATE}|{SSN}|(?:{CARD_LAYOUT})(?![0-9]))"
# digits after the country code, where a country has one number of them
NATIONAL = {8: "45|47|65|852", 9: "31|33|34|351|41|420|48|61", 10: "1|44|7|91"}
_FIXED = "|".join(rf"\+(?:{codes})[ .-]?(?:\(0\)[ .-]?)?\(?{_OWN}[0-9](?:[ .()-]{{0,2}}{_OWN}[0-9]){{{n - 1}}}(?![0-9])" for n, codes in NATIONAL.items())
# groups behind dots or hyphens, other than those behind the country code, end the number: a blank joins none to them
_JOINED = rf"(?:(?: (?<!(?<!\+[0-9]{{1,3}})(?<=[0-9])[.-][0-9]{{2,16}} )|[.-]){_OWN})?"
_ANY = rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,4}}\)[ .-]?)?{_OWN}[0-9]{{2,4}}(?:{_JOINED}[0-9]{{2,4}}){{1,4}}(?![0-9])"
PHONE = rf"{_FIXED}|{_ANY}|(?<![0-9])\(?[0-9]{{3}}\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}(?![0-9])"
SHAPED = "|".join((HEX, IP, DATE, SSN, PHONE))
NEVER = "(?!)"

IBAN_LENGTHS = (
    "NO15 BE16 DK18 FI18 FO18 GL18 NL18 SD18 FK18 MK19 SI19 AT20 BA20 EE20 KZ20 LT20 LU20 XK20 MN20 CH21 HR21 LI21 LV21 BG22 BH22 CR22 DE22 GB22 GE22 IE22 ME22 RS22 VA22 "
    "AE23 GI23 IL23 IQ23 OM23 TL23 SO23 AD24 CZ24 ES24 MD24 PK24 RO24 SA24 SE24 SK24 TN24 VG24 LY25 PT25 ST25 IS26 TR26 BI27 DJ27 FR27 GR27 IT27 MC27 MR27 SM27 "
    "AL28 AZ28 BY28 CY28 DO28 GT28 HU28 LB28 NI28 PL28 SV28 BR29 EG29 PS29 QA29 UA29 JO30 KW30 MU30 YE30 MT31 SC31 LC32 RU33"
)


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(value: str, pattern: str) -> str:
    return f"({value} RLIKE {_quote('^(?:' + pattern + ')$')})"


def permute_text(value: str, key: str, letters: int = 26) -> str:
    """SQL: ``value`` with its digits and letters permuted; other characters keep their places."""
    shift = "cast(conv(substring(s.k, (i % 16) * 4 + 1, 4), 16, 10) AS int)"
    step = (
        f"CASE WHEN c >= '0' AND c <= '9' THEN char(48 + (ascii(c) - 48 + {shift}) % 10) "
        f"WHEN c >= 'a' AND c <= 'z' THEN char(97 + (ascii(c) - 97 + {shift}) % {letters}) "
        f"WHEN c >= 'A' AND c <= 'Z' THEN char(65 + (ascii(c) - 65 + {shift}) % {letters}) ELSE c END"
    )
    half = f"cast(length({value}) / 2 AS int)"
    start = f"named_struct('a', substring({value}, 1, {half}), 'b', substring({value}, {half} + 1))"
    keyed = f"transform(array(s), s -> named_struct('a', s.a, 'b', s.b, 'k', sha2(concat({_quote(key)}, '|', r, '|', s.b), 256)))[0]"
    turn = f"transform(array({keyed}), s -> named_struct('a', s.b, 'b', array_join(transform(split(s.a, ''), (c, i) -> {step}), '')))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {turn}, s -> concat(s.a, s.b))"


def permute_number(left: str, right: str, sizes: tuple[int, int], key: str, result: str) -> str:
    """SQL: the pair of remainders permuted among ``sizes[0] * sizes[1]`` pairs; ``result`` reads it as ``s.a`` and ``s.b``."""
    start = f"named_struct('a', cast({left} AS bigint), 'b', cast({right} AS bigint), 'm', {sizes[0]}L, 'n', {sizes[1]}L)"
    add = f"cast(conv(substring(sha2(concat({_quote(key)}, '|', r, '|', s.b), 256), 1, 12), 16, 10) AS bigint)"
    turn = f"named_struct('a', s.b, 'b', (s.a + {add}) % s.m, 'm', s.n, 'n', s.m)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {turn}, s -> {result})"


def _once(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, which is then evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _luhn_sum(digits: str, doubled: int) -> str:
    """SQL: sum of digits where every second one, beginning ``doubled`` places from the right, counts double."""
    d = "cast(c AS int)"
    twice = f"(2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END)"
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN c = '' THEN 0 WHEN i % 2 = {doubled} THEN {twice} ELSE {d} END), 0, (s, x) -> s + x)"


def _plain(m: str, kept: str = "0-9") -> str:
    return f"regexp_replace({m}, '[^{kept}]', '')"


def _laid_out(m: str, characters: str, kept: str = "0-9") -> str:
    """SQL: the layout of ``m`` with its kept characters replaced, in order, by those of ``characters``."""
    nth = f"length({_plain(f'substring({m}, 1, i + 1)', kept)})"
    fill = f"array_join(transform(split({m}, ''), (c, i) -> CASE WHEN c RLIKE '[{kept}]' THEN substring(q, {nth}, 1) ELSE c END), '')"
    return _once(characters, "q", fill)


def _card(m: str, key: str) -> str:
    digits = _plain(m)
    new = _once(permute_text(f"substring({digits}, 1, length({digits}) - 1)", key), "p", f"concat(p, (10 - {_luhn_sum('p', 0)} % 10) % 10)")
    return f"CASE WHEN {_luhn_sum(digits, 1)} % 10 = 0 THEN {_laid_out(m, new)} ELSE {m} END"


def _mod97(text: str) -> str:
    step = "CASE WHEN c = '' THEN s WHEN c <= '9' THEN (s * 10 + cast(c AS int)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END"
    return f"aggregate(split({text}, ''), 0, (s, c) -> {step})"


def _iban(m: str, key: str) -> str:
    plain = f"replace({m}, ' ', '')"
    check = _mod97(f"concat(p, substring({plain}, 1, 2), '00')")
    new = _once(permute_text(f"substring({plain}, 5)", key), "p", f"concat(substring({plain}, 1, 2), lpad(98 - {check}, 2, '0'), p)")
    return f"CASE WHEN {_mod97(f'concat(substring({plain}, 5), substring({plain}, 1, 4))')} = 1 THEN {_laid_out(m, new, 'A-Z0-9')} ELSE {m} END"


def _ip(m: str, key: str) -> str:
    part = lambda i: f"cast(split({m}, '[.]')[{i}] AS int)"
    valid = " AND ".join(f"{part(i)} <= 255" for i in range(4))
    out = "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)"
    return f"CASE WHEN {valid} THEN {permute_number(f'{part(0)} * 256 + {part(1)}', f'{part(2)} * 256 + {part(3)}', (65536, 65536), key, out)} ELSE {m} END"


def _date(m: str, key: str) -> str:
    def within(day: str, shown: str) -> str:
        n = f"datediff({day}, date'{FIRST_DAY}')"
        new = f"date_add(date'{FIRST_DAY}', cast(s.a * 4297 + s.b AS int))"
        put = permute_number(f"{n} div 4297", f"{n} % 4297", (17, 4297), key, shown.format(new=new))
        return f"CASE WHEN {n} >= 0 AND {n} < {DAYS} THEN {put} ELSE {m} END"

    parsed = lambda y, mo, d: f"try_to_date(concat(substring({m}, {y}, 4), '-', substring({m}, {mo}, 2), '-', substring({m}, {d}, 2)), 'yyyy-MM-dd')"
    iso, day, month = parsed(1, 6, 9), parsed(7, 4, 1), parsed(7, 1, 4)
    sep = lambda at: f"substring({m}, {at}, 1)"
    show = lambda form, at: "concat_ws(" + sep(at) + ", " + ", ".join(f"date_format({{new}}, '{x}')" for x in form) + ")"
    return (
        f"CASE WHEN {m} RLIKE '^[0-9]{{4}}' THEN CASE WHEN {iso} IS NOT NULL THEN {within(iso, show(('yyyy', 'MM', 'dd'), 5))} ELSE {m} END "
        f"WHEN {day} IS NOT NULL THEN {within(day, show(('dd', 'MM', 'yyyy'), 3))} WHEN {month} IS NOT NULL THEN {within(month, show(('MM', 'dd', 'yyyy'), 3))} ELSE {m} END"
    )


def _ssn(m: str, key: str) -> str:
    area, group, serial = f"cast(substring({m}, 1, 3) AS int)", f"cast(substring({m}, 5, 2) AS int)", f"cast(substring({m}, 8, 4) AS int)"
    # areas 001-899 without 666
    place = f"({area} - 1 - CASE WHEN {area} > 666 THEN 1 ELSE 0 END)"
    out = "concat_ws('-', lpad(s.a + 1 + CASE WHEN s.a >= 665 THEN 1 ELSE 0 END, 3, '0'), lpad(s.b div 9999 + 1, 2, '0'), lpad(s.b % 9999 + 1, 4, '0'))"
    put = permute_number(place, f"({group} - 1) * 9999 + {serial} - 1", (898, 99 * 9999), key, out)
    return f"CASE WHEN {area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0 THEN {put} ELSE {m} END"


def pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of a found value ``m``, or ``m`` itself where it is not valid."""
    local = f"substring_index({m}, '@', 1)"
    code = f"regexp_extract({m}, {_quote('^[+][0-9]{1,3}(?![0-9])|^[+][0-9]{2}')}, 0)"
    rest = f"substring({m}, length({code}) + 1)"
    return (
        f"CASE WHEN instr({m}, '@') > 0 THEN concat({permute_text(local, key + '|email')}, '@', substring_index({m}, '@', -1)) "
        f"WHEN {_is(m, HEX)} THEN {permute_text(m, key + '|hex', 6)} "
        f"WHEN {m} RLIKE '^[A-Z]' THEN {_iban(m, key + '|iban')} "
        f"WHEN {_is(m, DATE)} THEN {_date(m, key + '|date')} "
        f"WHEN {_is(m, IP)} THEN {_ip(m, key + '|ip')} "
        f"WHEN {_is(m, SSN)} THEN {_ssn(m, key + '|ssn')} "
        f"WHEN {_is(m, PHONE)} THEN concat({code}, {_laid_out(rest, permute_text(_plain(rest), key + '|phone'))}) "
        f"ELSE {_card(m, key + '|card')} END"
    )


def _starts(text: str, pattern: str) -> str:
    """SQL: the match of ``pattern`` at each place where it can begin, so also those inside others."""
    return f"regexp_extract_all({text}, {_quote('(?=(' + GUARDED % pattern + '))')}, 1)"


def _prefixes(run: str) -> str:
    """SQL: the beginnings of a run of groups that end with a group, the longest first."""
    ends = f"filter(sequence(length({run}), 1, -1), e -> substring({run}, e + 1, 1) IN ('', ' ', '-'))"
    return f"transform({ends}, e -> substring({run}, 1, e))"


def valid_cards(text: str) -> str:
    """SQL: card numbers in the usual layouts (``usual``), and other groupings where none of these is part of them (``other``)."""
    right = lambda found: f"filter({found}, w -> length({_plain('w')}) BETWEEN 13 AND 19 AND {_luhn_sum(_plain('w'), 1)} % 10 = 0)"
    usual = right(f"concat({_starts(text, CARD_LAYOUT)}, {_starts(text, LONG_LAYOUT)})")
    # in a run of digits that is not spoken for, and in it the groups from any on
    runs = f"filter(regexp_extract_all({text}, {_quote(EMAIL + '|' + SHAPED + '|' + GUARDED % CARD)}, 0), w -> {_is('w', CARD)})"
    parts = f"flatten(transform({_starts(text, CARD_GROUPS)}, run -> {_prefixes('run')}))"
    other = f"filter({right(f'concat({runs}, {parts})')}, w -> NOT exists(u, y -> instr(w, y) > 0))"
    longest = f"array_sort(array_distinct({other}), (y, z) -> length(z) - length(y))"
    return _once(f"array_distinct({usual})", "u", f"named_struct('usual', u, 'other', {longest})")


def valid_ibans(text: str) -> str:
    """SQL: the IBANs of a text; of several with one beginning the one of the country's length first, then the longest."""
    plain = "replace(w, ' ', '')"
    right = f"length({plain}) BETWEEN 15 AND 34 AND {_mod97(f'concat(substring({plain}, 5), substring({plain}, 1, 4))')} = 1"
    usual = f"instr({_quote(IBAN_LENGTHS)}, concat(substring(w, 1, 2), length({plain}))) > 0"
    ordered = _once(f"filter({_prefixes('run')}, w -> {right})", "u", f"concat(filter(u, w -> {usual}), filter(u, w -> NOT {usual}))")
    return f"array_distinct(flatten(transform({_starts(text, IBAN)}, run -> {ordered})))"


def pattern_of(text: str) -> str:
    """SQL: the pattern of a text's values. Values with check digits are in it as they are, if they are valid."""
    literal = lambda values: f"CASE WHEN size({values}) > 0 THEN concat('(?<![0-9A-Za-z])(?:', array_join({values}, '|'), ')(?![0-9A-Za-z])') ELSE {_quote(NEVER)} END"
    none = "cast(array() AS array<string>)"
    ibans = f"CASE WHEN {text} RLIKE {_quote(IBAN.replace('{11,30}', '{11}'))} THEN {valid_ibans(text)} ELSE {none} END"
    cards = f"CASE WHEN {text} RLIKE {_quote(CARD.replace('{12,18}', '{12}'))} THEN {valid_cards(text)} ELSE named_struct('usual', {none}, 'other', {none}) END"
    joined = f"concat({_quote(EMAIL + '|')}, {literal('iban')}, '|', {literal('card.usual')}, {_quote('|' + SHAPED + '|')}, {literal('card.other')})"
    return _once(ibans, "iban", _once(cards, "card", joined))


def _unused(name: str, columns: list[str]) -> str:
    """``name``, or it with underscores behind, whatever columns there are."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced under the secret ``key``; all columns and rows are kept.

    ``count`` names a further column for the number of values that changed. Columns may have any names.
    """
    pattern, found, new, gaps = (_unused(name, docs.columns) for name in ("__pattern", "__found", "__new", "__gaps"))
    # expressions that are used twice get a projection of their own, behind which the optimiser does not repeat them
    staged = docs.withColumn(pattern, F.expr(f"CASE WHEN {text} RLIKE '[0-9@]' THEN {pattern_of(text)} END"))
    staged = staged.withColumn(found, F.expr(f"CASE WHEN {pattern} IS NOT NULL THEN regexp_extract_all({text}, {pattern}, 0) ELSE array() END"))
    staged = staged.withColumn(new, F.expr(f"transform({found}, m -> {pseudonym('m', key)})"))
    staged = staged.withColumn(gaps, F.expr(f"CASE WHEN size({found}) > 0 THEN split({text}, {pattern}, -1) END"))
    joined = F.expr(f"array_join(transform(arrays_zip({gaps}, {new}), x -> concat(x.{gaps}, coalesce(x.{new}, ''))), '')")
    out = F.when(F.size(found) > 0, joined).otherwise(F.col(text))
    changed = F.expr(f"size(filter(arrays_zip({found}, {new}), x -> x.{found} <> x.{new}))")
    return staged.select(*[out.alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns], *([changed.alias(count)] if count else []))
