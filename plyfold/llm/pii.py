"""Format-preserving pseudonyms for personal data: keyed Feistel permutations in SQL expressions only.

Every value found is permuted inside its own format by a keyed bijection, so equal values stay equal across documents and
different values stay different. Nothing is looked up and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# What each kind looks like. The order decides between kinds that begin at the same place.
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_YEAR = r"(?:1[89]|2[01])\d\d"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ipv4": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "iso_date": r"(?<![\w-])(?:1[89]|2[01])\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-])",
    "day_date": r"(?<![\w/])(?:0[1-9]|[12]\d|3[01])/(?:0[1-9]|1[0-2])/(?:1[89]|2[01])\d\d(?![\w/])",
    "slash_date": rf"(?<![\w/])\d{{1,2}}/\d{{1,2}}/{_YEAR}(?![\w/])",
    "dot_date": rf"(?<![\w.])(?:[12]\d|3[01]|0?[1-9])\.(?:1[0-2]|0?[1-9])\.{_YEAR}(?!\w|\.\d)",
    "year_date": rf"(?<![\w/]){_YEAR}/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])(?![\w/])",
    "month_date": rf"(?<!\w){_MONTH} \d{{1,2}}, {_YEAR}(?!\w)",
    "day_month": rf"(?<![\w.])\d{{1,2}} {_MONTH} {_YEAR}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![\w:])",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+?1[-. ]?)?(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-. ]\d{4}(?!\w)",
    "phone_e164": r"(?<![\w+])\+1[-. ]?(?:\(\d{3}\)|\d{3})[-. ]?\d{3}[-. ]?\d{4}(?!\w)",
    "phone_trunk": r"(?<![\w+-])0\d{1,3}-\d{3,4}-\d{4}(?![\w-])",
    "phone_abroad": r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w|[.-]\d)",
    # after cards, which may begin with three groups like these
    "phone_spaced": r"(?<![\w+])(?:1[-. ]?)?(?:\(\d{3}\)[-. ]?\d{3}[-. ]?|\d{3}[-. ]\d{3}[-. ])\d{4}(?!\w)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
DAYS = 146_097  # days of 400 years, 1800-01-01 to 2199-12-31: a whole cycle of the calendar, 189 * 773


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, kind: str, parts: str, mod: str) -> str:
    """A keyed number below mod from the text expression `parts`."""
    return f"pmod(cast(conv(substr(sha2(concat({_sql(key + '|')}, {kind}, '|', {parts}), 256), 1, 13), 16, 10) as bigint), {mod})"


def feistel(key: str, kind: str, a: str, b: str, n_a: str, n_b: str) -> str:
    """SQL for struct(a, b), a permutation of the pairs (a, b) with 0 <= a < n_a and 0 <= b < n_b.

    Rounds add a hash of one half to the other in turn, modulo its size, so every pair of sizes is a domain of its own and no
    value has to be walked back into it.
    """
    f_b = _hash(key, kind, "cast(r as string), ':', cast(s.b as string)", n_a)
    f_a = _hash(key, kind, "cast(r as string), ':', cast(s.a as string)", n_b)
    step = f"if(r % 2 = 1, named_struct('a', pmod(s.a + {f_b}, {n_a}), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b + {f_a}, {n_b})))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> {step})"


def letters(key: str, text: str) -> str:
    """SQL that permutes the letters and digits of a text, each within its class, by a Feistel network over the two halves."""
    half = f"cast(length({text}) div 2 as int)"
    shift = "cast(conv(substr(h, 1 + 2 * (i % 30), 4), 16, 10) as bigint)"
    one = (
        "case when c between '0' and '9' then chr(cast(48 + (ascii(c) - 48 + {s}) % 10 as bigint))"
        " when c between 'a' and 'z' then chr(cast(97 + (ascii(c) - 97 + {s}) % 26 as bigint))"
        " when c between 'A' and 'Z' then chr(cast(65 + (ascii(c) - 65 + {s}) % 26 as bigint)) else c end"
    ).format(s=shift)
    each = f"array_join(transform(split(x, ''), (c, i) -> {one}), '')"

    def moved(what: str, other: str) -> str:
        h = f"sha2(concat({_sql(key + '|letters|')}, cast(r as string), ':', length(s.a), ':', {other}), 256)"
        return f"transform(array(named_struct('x', {what}, 'h', {h})), y -> {each.replace('split(x,', 'split(y.x,').replace('substr(h,', 'substr(y.h,')})[0]"

    step = f"if(r % 2 = 1, named_struct('a', {moved('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {moved('s.b', 's.a')}))"
    return f"transform(array(aggregate(sequence(1, {ROUNDS}), named_struct('a', left({text}, {half}), 'b', substr({text}, {half} + 1)), (s, r) -> {step})), z -> concat(z.a, z.b))[0]"


def hexed(key: str, text: str) -> str:
    """SQL that permutes a text of two or more lower-case hex digits by a Feistel network over its halves."""
    half = f"cast(length({text}) div 2 as int)"
    alphabet = "'0123456789abcdef'"

    def moved(what: str, other: str) -> str:
        h = f"sha2(concat({_sql(key + '|hex|')}, cast(r as string), ':', length(s.a), ':', {other}), 256)"
        one = f"substr({alphabet}, cast(pmod(instr({alphabet}, c) - 1 + cast(conv(substr(y.h, 1 + i, 1), 16, 10) as int), 16) + 1 as int), 1)"
        return f"transform(array(named_struct('x', {what}, 'h', {h})), y -> array_join(transform(split(y.x, ''), (c, i) -> {one}), ''))[0]"

    step = f"if(r % 2 = 1, named_struct('a', {moved('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {moved('s.b', 's.a')}))"
    return f"transform(array(aggregate(sequence(1, {ROUNDS}), named_struct('a', left({text}, {half}), 'b', substr({text}, {half} + 1)), (s, r) -> {step})), z -> concat(z.a, z.b))[0]"


def mod97(text: str) -> str:
    """SQL for a text of digits and capital letters as a number (A is 10, Z is 35), modulo 97."""
    return f"aggregate(split({text}, ''), 0, (t, c) -> if(c between '0' and '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97))"


def placed(shape: str, text: str, kept: str) -> str:
    """SQL that puts a text's characters one after the other into the places of a shape's characters that the class `kept` does not hold."""
    at = f"length(regexp_replace(left({shape}, i + 1), {_sql('[' + kept + ']')}, ''))"
    return f"array_join(transform(split({shape}, ''), (c, i) -> if(c rlike {_sql('[' + kept + ']')}, c, substr({text}, {at}, 1))), '')"


def luhn(digits: str) -> str:
    """SQL for the Luhn sum of a digit string, modulo 10; 0 is valid."""
    double = f"pmod(length({digits}) - i, 2) = 1"
    value = f"cast(substr({digits}, i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + if({double}, {value} * 2 - if({value} > 4, 9, 0), {value})) % 10"


def refilled(shape: str, digits: str, skip: str) -> str:
    """SQL that puts digits into the places of a text's digits, after its first `skip` digits."""
    place = f"length(regexp_replace(left({shape}, i + 1), '[^0-9]', '')) - {skip}"
    return f"array_join(transform(split({shape}, ''), (c, i) -> if(c between '0' and '9' and {place} > 0, substr({digits}, cast({place} as int), 1), c)), '')"


def _digits(key: str, kind: str, d: str) -> str:
    """SQL that permutes a string of 2 to 36 digits."""
    half = f"cast(length({d}) div 2 as int)"
    n = [f"cast(pow(10, {x}) as bigint)" for x in (half, f"(length({d}) - {half})")]
    f = feistel(key, kind, f"left({d}, {half})", f"substr({d}, {half} + 1)", *n)
    return f"transform(array({f}), z -> concat(lpad(cast(z.a as string), {half}, '0'), lpad(cast(z.b as string), length({d}) - {half}, '0')))[0]"


def pseudonym(key: str, m: str = "m") -> str:
    """SQL for the pseudonym of a value m that one of PATTERNS found."""
    only = f"regexp_replace({m}, '[^0-9]', '')"
    whole = {k: f"{m} rlike {_sql('^(?:' + p + ')$')}" for k, p in PATTERNS.items()}
    octet = [f"cast(split_part({m}, '.', {i}) as bigint)" for i in (1, 2, 3, 4)]
    ip = feistel(key, "'ipv4'", f"{octet[0]} * 256 + {octet[1]}", f"{octet[2]} * 256 + {octet[3]}", "65536", "65536")
    ipv4 = f"transform(array({ip}), z -> concat_ws('.', z.a div 256, z.a % 256, z.b div 256, z.b % 256))[0]"

    def date(pattern: str) -> str:
        day = f"datediff(try_to_timestamp({m}, '{pattern}'), date'1800-01-01')"
        f = feistel(key, "'date'", f"{day} div 773", f"{day} % 773", "189", "773")
        return f"if({day} is null or {day} < 0 or {day} >= {DAYS}, {m}, transform(array({f}), z -> date_format(date_add(date'1800-01-01', cast(z.a * 773 + z.b as int)), '{pattern}'))[0])"

    # without leading zeros where the text has none; a first number over 12 can only be the day, a second one over 12 too
    first, second = (f"cast(split_part({m}, '/', {i}) as int)" for i in (1, 2))
    padded = f"{m} rlike '^[0-9]{{2}}/[0-9]{{2}}/'"
    slash = f"case when {second} <= 12 and {padded} then {date('dd/MM/yyyy')} when {second} <= 12 then {date('d/M/yyyy')} when {first} <= 12 and {padded} then {date('MM/dd/yyyy')} when {first} <= 12 then {date('M/d/yyyy')} else {m} end"
    dot = f"if({m} rlike '^[0-9]{{2}}[.][0-9]{{2}}[.]', {date('dd.MM.yyyy')}, {date('d.M.yyyy')})"
    long = f"{m} rlike '[a-z]{{3}}'"  # more than the three letters of a short name; May is both
    month = f"if({long}, {date('MMMM d, yyyy')}, {date('MMM d, yyyy')})"
    day_month = f"if({long}, {date('d MMMM yyyy')}, {date('d MMM yyyy')})"
    compact = f"replace({m}, ' ', '')"
    body = f"transform(array({letters(key, f'substr({compact}, 5)')}), b -> concat(left({m}, 2), lpad(cast(98 - {mod97(f'concat(b, left({m}, 2), ' + _sql('00') + ')')} as string), 2, '0'), b))[0]"
    iban = f"if({mod97(f'concat(substr({compact}, 5), left({compact}, 4))')} = 1, transform(array({body}), q -> {placed(m, 'q', ' ')})[0], {m})"
    nibbles = f"regexp_replace(lower({m}), ':', '')"
    six = f"transform(array({hexed(key, nibbles)}), q -> {placed(m, f'if({m} rlike {_sql("[A-F]")}, upper(q), q)', ':')})[0]"
    area, group, serial = (f"cast(split_part({m}, '-', {i}) as bigint)" for i in (1, 2, 3))
    number = feistel(key, "'ssn'", f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", "88902", "9999")
    ssn = f"transform(array({number}), z -> concat_ws('-', lpad(cast(z.a div 99 + if(z.a div 99 > 664, 2, 1) as string), 3, '0'), lpad(cast(z.a % 99 + 1 as string), 2, '0'), lpad(cast(z.b + 1 as string), 4, '0')))[0]"
    # a North American number: its last ten digits; a valid one (area and exchange begin with 2 to 9) stays valid
    ten, extra = f"right({only}, 10)", f"(length({only}) - 10)"
    valid = f"{ten} rlike '^[2-9][0-9]{{2}}[2-9]'"
    low = f"(left({ten}, 3) - 200) * 100 + substr({ten}, 7, 2)", f"(substr({ten}, 4, 3) - 200) * 100 + right({ten}, 2)"
    kept = feistel(key, "'phone'", *low, "80000", "80000")
    inside = f"transform(array({kept}), z -> concat(cast(200 + z.a div 100 as string), cast(200 + z.b div 100 as string), lpad(cast(z.a % 100 as string), 2, '0'), lpad(cast(z.b % 100 as string), 2, '0')))[0]"
    # a number that is not valid moves in its own first digit's class, so that it can't meet a valid one
    outside = f"transform(array(named_struct('d', {ten})), y -> concat(left(y.d, 1), {_digits(key, _sql('phone-3'), 'substr(y.d, 2, 2)')}, substr(y.d, 4, 1), {_digits(key, _sql('phone-6'), 'right(y.d, 6)')}))[0]"
    phone = refilled(m, "q", extra)
    phone = f"transform(array(if({valid}, {inside}, {outside})), q -> {phone})[0]"
    trunk = f"transform(array({_digits(key, _sql('trunk'), f'substr({only}, 2)')}), q -> {refilled(m, 'q', '1')})[0]"
    code = f"length(regexp_replace(regexp_extract({m}, '^[+][0-9]+', 0), '[^0-9]', ''))"
    code = f"least({code}, 2)"
    tail = f"substr({only}, {code} + 1)"
    abroad = f"transform(array({_digits(key, _sql('abroad'), tail)}), q -> {refilled(m, 'q', code)})[0]"
    # a card keeps its first digit and its length; the check digit is computed anew, and a number whose check digit is wrong is no card
    middle = f"substr({only}, 2, length({only}) - 2)"
    checked = f"transform(array(concat(left({only}, 1), {_digits(key, _sql('card'), middle)})), y -> concat(y, cast(pmod(10 - {luhn('concat(y, ' + _sql('0') + ')')}, 10) as string)))[0]"
    card = f"if({luhn(only)} = 0, transform(array({checked}), q -> {refilled(m, 'q', '0')})[0], {m})"
    local = f"split_part({m}, '@', 1)"
    plain = f"regexp_replace({local}, '[^A-Za-z0-9]', '')"
    spot = f"length(regexp_replace(left({local}, i + 1), '[^A-Za-z0-9]', ''))"
    email = f"transform(array({letters(key, plain)}), q -> concat(array_join(transform(split({local}, ''), (c, i) -> if(c rlike '[A-Za-z0-9]', substr(q, {spot}, 1), c)), ''), substr({m}, length({local}) + 1)))[0]"
    made = {
        "email": email,
        "ipv4": ipv4,
        "iso_date": date("yyyy-MM-dd"),
        "day_date": date("dd/MM/yyyy"),
        "slash_date": slash,
        "dot_date": dot,
        "year_date": date("yyyy/MM/dd"),
        "month_date": month,
        "day_month": day_month,
        "iban": iban,
        "ipv6": six,
        "ssn": ssn,
        "phone": phone,
        "phone_e164": phone,
        "phone_trunk": trunk,
        "phone_abroad": abroad,
        "card": card,
        "phone_spaced": phone,
    }
    return "case " + " ".join(f"when {whole[k]} then {made[k]}" for k in made) + f" else {m} end"


def pseudonymize(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """df with `text_col` pseudonymised and a column n_values, the number of values replaced; other columns stay as they are.

    Replaced by a permutation of their format under `key`: local parts of e-mail addresses, IPv4 and IPv6 addresses, dates of 1800
    to 2199 (2024-03-01, 2024/03/01, 01/03/2024, 1/3/2024, 03/14/2024, 01.03.2024, March 1, 2024, 1 March 2024, short month names),
    US social security numbers, telephone numbers (North American, international with +, national with a leading 0 and dashes),
    IBANs with right check digits and numbers of 13 to 19 digits with a right Luhn digit, as payment cards have. Separators,
    lengths, country codes and first card digits stay, check digits are made right. A date is one value in all its forms. Left as
    they are: dates that no calendar has, numbers with wrong check digits, ten bare digits (a North American number needs +1 or
    separators), nine bare digits, secrets such as keys. Null text stays null with n_values 0; n_values counts the values
    that changed; repeated rows get equal results; an n_values column of the input is
    replaced, all other columns stay, whatever their names. Texts of any length are done whole.

    The key is part of the plan: set spark.sql.redaction.string.regex where plans are logged.
    """
    text = F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    names = F.transform(F.when(text.rlike(r"[\d@]") & text.rlike(ANY), found), lambda m: F.struct(m.alias("old")))
    free = "__pii"
    while free in df.columns:
        free += "_"
    out = df.withColumn(free, names).withColumn(free, F.expr(f"transform({free}, x -> named_struct('old', x.old, 'new', transform(array(x.old), m -> {pseudonym(key)})[0]))"))
    joined = F.call_function("array_join", F.transform(F.split(text, ANY, -1), lambda x, i: F.concat(x, F.coalesce(F.get(F.col(free), i)["new"], F.lit("")))), F.lit(""))
    return out.withColumns({text_col: F.when(F.col(free).isNull(), text).otherwise(joined), "n_values": F.coalesce(F.size(F.filter(free, lambda x: x["old"] != x["new"])), F.lit(0)).cast("long")}).drop(free)
