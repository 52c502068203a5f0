r"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets in running text.

DataFrame and SQL functions alone. A value is found by a pattern, validated (check digits, ranges,
calendar) and written as an array of numbers, each below a base of its own; a keyed Feistel network
over that mixed radix permutes the arrays, so the output is valid in the same format, different
values stay different within a format, and equal values get equal pseudonyms in all documents,
whatever separators they are written with. Values that fail validation stay as they are.

| kind | found | permuted |
|-|-|-|
| secret | a value after password, token, secret, api_key and the like | hex digits, or letters and digits within their class |
| email | name@domain | letters and digits of the name within their class, in lower case; the domain stays |
| date | y-m-d (also before a time), d/m/y, d.m.y, m/d/y, and with an English month; 1900 to 2099 and in the calendar | day, month and year, to another date of the calendar |
| ssn | ddd-dd-dddd with a valid area, group and serial | all three within their valid ranges |
| ip, ip6 | four octets; eight groups of hex digits | all of them |
| iban | country, check digits and account, check digits right | the account, within its classes; check digits are computed anew |
| phone | an international or bracketed or grouped number, 8 to 15 digits | the last ten digits; leading ones of area and exchange stay in 2 to 9 |
| card | 13 to 19 digits that pass the Luhn check | all but the check digit, which is computed anew |

A date has one pseudonym in whatever order and form it is written. Days up to the 12th stay so, and
those from the 13th to the 28th, so a month that is written first is read as such again.

Each round adds to one half a SHA-512 keyed hash of the other, number by number modulo its base.
Numbers of only one digit can't be hidden by any permutation of their format; single letters in a
mail name have 26 pseudonyms.

Defined results: null and empty texts stay so; texts without a match stay as they are; repeated rows
give repeated rows; other columns aren't touched, whatever their names; empty tables stay empty; texts
of any length are searched whole; where two kinds match at one place the first of the table counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Callers pass a key of their own; this one only makes tests and checks repeatable.
DEFAULT_KEY = "tidelog-demo-key"
ROUNDS = 10

_SECRET_HEAD = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "|".join([*_MONTHS, *(m[:3] for m in _MONTHS if m != "may")])
#: In the order in which they are tried at a position. Java patterns; quantifiers are possessive or
#: bounded, so no text makes them backtrack far.
PATTERNS: dict[str, str] = {
    "secret": rf"(?i:(?<![a-z]){_SECRET_HEAD})[A-Za-z0-9_+/.=-]{{6,}}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+",
    "date": r"(?<![\w./-])\d{4}-\d{2}-\d{2}(?=[Tt]\d{2}:)|(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
    rf"|\d{{1,2}} (?i:{_MONTH}) \d{{4}}|(?i:{_MONTH}) \d{{1,2}}, \d{{4}})(?![\w/-])(?!\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w)(?!\.\d)",
    "ip6": r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{4}(?!\w)|(?<![\w+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w+-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])",
}


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


def _all_kinds() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def feistel(values: str, bases: str, kind: str, key: str) -> str:
    """SQL: values, an array of ints each below that of bases, permuted. Halves take turns."""
    other = "array_join(filter(s, (x, j) -> (j < size(s) div 2) <> (i % 2 = 0)), ',')"
    digest = f"sha2(concat_ws('|', '{key}', '{kind}', array_join(b, ','), i, {other}, '{key}'), 512)"
    # 4 hex digits for each number; from the 33rd on they serve again, moved by the number's place
    shift = "cast(conv(substr(h, 4 * (j % 32) + 1, 4), 16, 10) as int) + 7919 * (j div 32)"
    moved = f"transform(array({digest}), h -> transform(s, (x, j) -> if((j < size(s) div 2) = (i % 2 = 0), cast((x + {shift}) % get(b, j) as int), x)))[0]"
    first = f"transform({values}, x -> cast(x as int))"
    return f"transform(array({bases}), b -> aggregate(sequence(0, {ROUNDS - 1}), {first}, (s, i) -> {moved}))[0]"


_DIGITS = "transform(split(regexp_replace(m, '[^0-9]', ''), ''), c -> cast(c as int))"


def _refilled(digits: str) -> str:
    """SQL: m with its digits replaced, one after another, by those of a string."""
    nth = "length(regexp_replace(substr(m, 1, i + 1), '[^0-9]', ''))"
    return f"array_join(transform(array({digits}), d -> transform(split(m, ''), (c, i) -> if(c rlike '[0-9]', substr(d, {nth}, 1), c)))[0], '')"


def _luhn_sum(digits: str) -> str:
    """SQL: of an array of digits to which a check digit is to be appended."""
    doubled = "transform(reverse(v), (x, i) -> if(i % 2 = 0, if(x > 4, 2 * x - 9, 2 * x), x))"
    return f"transform(array({digits}), v -> aggregate({doubled}, 0, (a, x) -> a + x))[0]"


def _letters(kind: str, key: str, source: str, may_be_hex: bool = True) -> str:
    """SQL: the characters of a string, each within its class; hex strings within 0-9a-f."""
    hexed = f"{source} rlike '^[0-9a-f]{{8,}}$'" if may_be_hex else "false"
    alphabet = "case when x then '0123456789abcdef' when c rlike '[0-9]' then '0123456789' when c rlike '[a-z]' then 'abcdefghijklmnopqrstuvwxyz' when c rlike '[A-Z]' then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' else c end"
    classes = f"transform(array({hexed}), x -> transform(split({source}, ''), c -> {alphabet}))[0]"
    values = "transform(split(o, ''), (c, i) -> locate(c, get(k, i)) - 1)"
    permuted = feistel(values, "transform(k, a -> length(a))", kind, key)
    back = f"array_join(transform({permuted}, (v, i) -> substr(get(k, i), v + 1, 1)), '')"
    return f"transform(array({source}), o -> transform(array({classes}), k -> {back})[0])[0]"


def _secret(key: str) -> str:
    head = _quoted(rf"^(?i:{_SECRET_HEAD})")
    value = f"regexp_replace(m, {head}, '')"
    return f"concat(substr(m, 1, length(m) - length({value})), {_letters('secret', key, value)})"


def _email(key: str) -> str:
    name = "lower(substring_index(m, '@', 1))"
    return f"concat({_letters('email', key, name)}, '@', substring_index(m, '@', -1))"


def _ip(key: str) -> str:
    octets = "transform(split(m, '[.]'), c -> cast(c as int))"
    return f"if(forall({octets}, x -> x < 256), array_join({feistel(octets, 'array(256, 256, 256, 256)', 'ip', key)}, '.'), m)"


def _ip6(key: str) -> str:
    groups = "transform(split(m, ':'), c -> cast(conv(c, 16, 10) as int))"
    bases = "array_repeat(65536, 8)"
    return f"lower(array_join(transform({feistel(groups, bases, 'ip6', key)}, x -> hex(x)), ':'))"


def _iban(key: str) -> str:
    def rest(of: str) -> str:
        """SQL: of a string with letters as two digits, modulo 97."""
        return f"aggregate(split({of}, ''), 0, (a, c) -> (a * if(c rlike '[0-9]', 10, 100) + if(c rlike '[0-9]', cast(c as int), ascii(c) - 55)) % 97)"

    moved = _letters("iban", key, "substr(w, 5)", False)
    check = f"lpad(cast(98 - {rest("concat(z, substr(w, 1, 2), '00')")} as string), 2, '0')"
    whole = f"transform(array({moved}), z -> concat(substr(w, 1, 2), {check}, z))[0]"
    nth = "length(replace(substr(m, 1, i + 1), ' ', ''))"
    spaced = f"array_join(transform(split(m, ''), (c, i) -> if(c = ' ', c, substr(x, {nth}, 1))), '')"
    valid = f"{rest('concat(substr(w, 5), substr(w, 1, 4))')} = 1"
    return f"transform(array(replace(m, ' ', '')), w -> if({valid}, transform(array({whole}), x -> {spaced})[0], m))[0]"


def _ssn(key: str) -> str:
    area, group, serial = "cast(substr(m, 1, 3) as int)", "cast(substr(m, 5, 2) as int)", "cast(substr(m, 8, 4) as int)"
    values = f"array({area} - if({area} > 666, 2, 1), {group} - 1, {serial} - 1)"
    written = "format_string('%03d-%02d-%04d', v[0] + if(v[0] >= 665, 2, 1), v[1] + 1, v[2] + 1)"
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    return f"if({valid}, transform(array({feistel(values, 'array(898, 99, 9999)', 'ssn', key)}), v -> {written})[0], m)"


def _phone(key: str) -> str:
    last = "slice(d, greatest(1, size(d) - 9), least(10, size(d)))"
    # leading digits of area and exchange: 2 to 9 stay in that range, others stay as they are
    national = "(size(t) = 10 and t[0] > 1 and t[3] > 1)"
    bases = f"transform(t, (x, i) -> if(size(t) = 10 and i in (0, 3), if({national}, 8, 1), 10))"
    values = f"transform(t, (x, i) -> if(size(t) = 10 and i in (0, 3), if({national}, x - 2, 0), x))"
    moved = f"transform({feistel(values, bases, 'phone', key)}, (x, i) -> if(size(t) = 10 and i in (0, 3), if({national}, x + 2, t[i]), x))"
    whole = f"transform(array({last}), t -> concat(slice(d, 1, size(d) - size(t)), {moved}))[0]"
    digits = f"transform(array({_DIGITS}), d -> array_join({whole}, ''))[0]"
    return f"if(length(regexp_replace(m, '[^0-9]', '')) between 8 and 15, {_refilled(digits)}, m)"


def _card(key: str) -> str:
    payload = "slice(d, 1, size(d) - 1)"
    moved = feistel(payload, f"transform({payload}, x -> 10)", "card", key)
    digits = f"transform(array({_DIGITS}), d -> transform(array({moved}), p -> concat(array_join(p, ''), cast((10 - {_luhn_sum('p')} % 10) % 10 as string)))[0])[0]"
    valid = f"transform(array({_DIGITS}), d -> ({_luhn_sum(payload)} + element_at(d, -1)) % 10 = 0)[0]"
    return f"if({valid}, {_refilled(digits)}, m)"


def _date(key: str) -> str:
    """Days to the 12th, to the 28th and after that are permuted with month and year in classes of
    their own, each closed and valid; 29 February moves among leap years."""
    low = f"transform(array(if(v.d <= 12, 1, 13)), lo -> transform(array({feistel('array(v.d - lo, v.mo - 1, v.y - 1900)', 'array(if(lo = 1, 12, 16), 12, 200)', 'date', key)}), z -> array(z[0] + lo, z[1] + 1, z[2] + 1900))[0])[0]"
    # the 29th and 30th of eleven months and the 31st of seven, numbered one after another
    most, long = "array(1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)", "array(1, 3, 5, 7, 8, 10, 12)"
    number = f"cast(if(v.d = 31, 21 + array_position({long}, v.mo), 11 * (v.d - 29) - 1 + array_position({most}, v.mo)) as int)"
    named = f"if(z[0] < 22, array(29 + z[0] div 11, {most}[cast(z[0] % 11 as int)], z[1] + 1900), array(31, {long}[z[0] - 22], z[1] + 1900))"
    high = f"transform(array({feistel(f'array({number}, v.y - 1900)', 'array(29, 200)', 'date-end', key)}), z -> transform({named}, x -> cast(x as int)))[0]"
    leap = f"transform(array({feistel('array((v.y - 1904) div 4)', 'array(49)', 'date-leap', key)}), z -> array(29, 2, 1904 + 4 * z[0]))[0]"
    # how o, the new day, month and year, is written
    sep = "regexp_extract(m, '[-/.]', 0)"
    first, second = "if(v.swap, o[1], o[0])", "if(v.swap, o[0], o[1])"
    two = "if(m rlike '^[0-9]{2}[/.][0-9]{2}[/.]', '%02d', '%d')"
    numbers = f"concat(format_string({two}, {first}), {sep}, format_string({two}, {second}), {sep}, format_string('%04d', o[2]))"
    months = "array(" + ", ".join(f"'{x}'" for x in _MONTHS) + ")"
    whole = f"transform(array(get({months}, o[1] - 1)), x -> if(length(v.name) > 3 or lower(v.name) = 'may', x, substr(x, 1, 3)))[0]"
    cased = f"transform(array({whole}), x -> if(v.name = upper(v.name), upper(x), if(v.name = lower(v.name), x, initcap(x))))[0]"
    day = "format_string(if(m rlike '(^| )0[0-9][ ,]', '%02d', '%d'), o[0])"
    words = f"if(m rlike '^[0-9]', concat({day}, ' ', {cased}, ' ', format_string('%04d', o[2])), concat({cased}, ' ', {day}, ', ', format_string('%04d', o[2])))"
    written = f"case when v.iso then format_string('%04d-%02d-%02d', o[2], o[1], o[0]) when v.name <> '' then {words} else {numbers} end"
    # try_to_date decides what is in the calendar
    exists = "try_to_date(format_string('%04d-%02d-%02d', v.y, v.mo, v.d), 'yyyy-MM-dd') is not null"
    chosen = f"case when v.mo = 2 and v.d = 29 then {leap} when v.d > 28 then {high} else {low} end"
    body = f"if(v.y between 1900 and 2099 and v.mo between 1 and 12 and v.d between 1 and 31 and {exists}, transform(array({chosen}), o -> {written})[0], m)"
    by_name = f"cast(array_position(transform({months}, x -> substr(x, 1, 3)), lower(substr(a.name, 1, 3))) as int)"
    d = "case when a.name <> '' then p[0] when a.iso then p[2] when a.swap then p[1] else p[0] end"
    mo = f"case when a.name <> '' then {by_name} when a.iso or not a.swap then p[1] else p[0] end"
    y = "if(a.iso, p[0], element_at(p, -1))"
    struct = f"named_struct('d', {d}, 'mo', {mo}, 'y', {y}, 'iso', a.iso, 'swap', a.swap, 'name', a.name)"
    about = "named_struct('iso', m rlike '^[0-9]{4}-', 'swap', p[0] <= 12 and p[1] > 12, 'name', regexp_extract(m, '[A-Za-z]+', 0))"
    part = "transform(regexp_extract_all(m, '[0-9]+', 0), c -> cast(c as int))"
    return f"transform(array({part}), p -> transform(array({about}), a -> transform(array({struct}), v -> {body})[0])[0])[0]"


_MAKE = {"secret": _secret, "email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "ip6": _ip6, "iban": _iban, "phone": _phone, "card": _card}


def pseudonym(key: str = DEFAULT_KEY) -> str:
    """SQL for the pseudonym of m, one match of PATTERNS."""
    if not key.replace("-", "").replace("_", "").isalnum():
        raise ValueError("keys have letters, digits, - and _")
    cases = " ".join(f"when m rlike {_quoted('^(?:' + p + ')$')} then {_MAKE[kind](key)}" for kind, p in PATTERNS.items())
    return f"case {cases} else m end"


def pseudonymised(text: str, key: str = DEFAULT_KEY) -> Column:
    """The text of a column with every validated value replaced."""
    pattern = _quoted(_all_kinds())
    gaps, found = f"split(`{text}`, {pattern}, -1)", f"regexp_extract_all(`{text}`, {pattern}, 0)"
    # most texts have neither a digit nor an @ nor a secret's name; of the rest, few have a match
    some = f"`{text}` rlike '[0-9@]|(?i:pass|pwd|token|secret|key)|:[0-9a-fA-F]{{1,4}}:' and `{text}` rlike {pattern}"
    whole = f"transform(array({gaps}), g -> concat(g[0], array_join(transform({found}, (m, n) -> concat({pseudonym(key)}, g[n + 1])), '')))[0]"
    return F.expr(f"case when {some} then {whole} else `{text}` end")


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """docs with the text replaced; all other columns stay."""
    return docs.withColumn("text", pseudonymised("text", key))
