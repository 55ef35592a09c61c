"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation.

One pattern finds e-mail addresses, card numbers, IBANs, US social security numbers, phone numbers, IPv4 and IPv6 addresses, dates, secret
hexadecimal tokens and passwords with a digit. What validates (Luhn, mod 97, calendar, octet range, area rules, count of digits) is replaced by its image under a
balanced Feistel network on its own characters, whose round function is an HMAC, so the format stays and equal values map to equal
values in every document; what does not validate stays as it is.

* Card numbers keep their separators and end in a valid check digit; IBANs keep country and length, with
  new check digits; phone numbers keep +country and the exchange layout; octets permute in 0-255; a date
  permutes within its century; hexadecimal tokens, the body of an IBAN and the local part of an e-mail permute as a whole among the strings of
  their layout (letters stay letters of their case, digits stay digits; case takes no part, so A@x and a@x stay linked); e-mail domains stay.
* A run of groups of digits that is no card may hold one: its endings and beginnings at group borders are tried, longest first, and so are
  the beginnings of what looks like an IBAN.

The key is a setting, spark.lorespark.pii.secret, which Spark does not show. Without it a session makes a random one, so pseudonyms are linked within the session only
and nobody can invert them.

Native: DataFrame functions only; the match list of a text is rewritten in its row, nothing shuffles.

Defined results: null text stays null with no matches; texts are read whole; overlapping
candidates go to the leftmost, then to the kind listed first; n_found counts candidates, whether they validate or not, and n_replaced
those that changed; columns of these two names are replaced, other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import table

ROUNDS = 8
#: Setting that names the key; characters of a Feistel half that one digest covers.
KEY, STREAM = "spark.lorespark.pii.secret", 16
#: The patterns of what is looked for, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])\+?1?[ .-]?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9A-Za-z.+-])(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9+])\+[1-9][0-9]{6,14}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{2,5}(?:[ .-]?[0-9]{2,8}){1,4}(?![0-9])|(?<![0-9+.-])00[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
    "password": r"(?<=(?:password|passwd|pwd)[ ]{0,3}[=:][ ]{0,3}[\x22']?)(?=[!-~]{0,63}[0-9])[!#-&(-~]{6,64}(?![!-~])",
    "token": r"(?<=(?:token|secret|apikey|api_key|password|passwd)[ ]{0,3}[=:][ ]{0,3}[\x22']?)[0-9A-Fa-f]{16,128}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])",
}
ANY = "|".join(PATTERNS.values())


def session_key(spark: SparkSession) -> str:
    """The key that the setting names, else a random one that the session keeps."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def _hmac(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, as hexadecimal digits."""
    block = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _prf(key: str, *parts: Column) -> Column:
    """A keyed number below 16^15."""
    return F.conv(F.substring(_hmac(key, *parts), 1, 15), 16, 10).cast("bigint")


def feistel(value_a: Column, value_b: Column, size_a: Column, size_b: Column, key: str, tweak: Column) -> Column:
    """A permutation of the pairs (a, b) with a < size_a and b < size_b, as a struct (a, b); ROUNDS is even."""
    start = F.struct(value_a.cast("bigint").alias("a"), value_b.cast("bigint").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_a).otherwise(size_b).cast("bigint")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + _prf(key, i, tweak, s["b"]), size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length; a single digit stays."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.rpad(F.lit("1"), 19, "0").substr(F.lit(1), k + 1).cast("bigint")
    out = feistel(digits.substr(F.lit(1), u), digits.substr(u + 1, n - u), ten(u), ten(n - u), key, F.concat(F.lit(tweak), n.cast("string")))
    return F.when(n < 2, digits).otherwise(F.concat(F.lpad(out["a"].cast("string"), u, "0"), F.lpad(out["b"].cast("string"), n - u, "0")))


def fill(layout: Column, digits: Column) -> Column:
    """layout with its digits replaced, in order, by those of another string of as many."""
    gaps, own = F.split(layout, "[0-9]", -1), F.split(digits, "")
    return F.concat_ws("", F.zip_with(gaps, own, lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))))


def fill_hex(layout: Column, digits: Column) -> Column:
    """layout with its hexadecimal digits replaced, in order."""
    gaps, own = F.split(layout, "[0-9A-Fa-f]", -1), F.split(digits, "")
    return F.concat_ws("", F.zip_with(gaps, own, lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))))


def luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; doubled_last: the last digit counts twice, as for the digits before a check digit."""
    odd = 0 if doubled_last else 1

    def each(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == odd, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), each), F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """Letters count as 10 to 35; the number's remainder by 97."""
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97)


def _shifted(text: Column, stream: Column, hexadecimal: bool) -> Column:
    """text with each digit or letter moved on within its class by four hexadecimal digits of stream."""

    def each(c: Column, i: Column) -> Column:
        move = F.conv(stream.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        if hexadecimal:
            return F.substring(F.lit("0123456789abcdef"), (F.conv(c, 16, 10).cast("int") + move) % 16 + 1, F.lit(1))
        for first, size in ((48, 10), (97, 26), (65, 26)):
            c = F.when(code.between(first, first + size - 1), F.char(first + (code - first + move) % size)).otherwise(c)
        return c

    letters = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.concat_ws("", F.transform(letters, each))


def _permuted(text: Column, key: str, tweak: str, hexadecimal: bool = False) -> Column:
    """A Feistel network on the halves of a whole text: each round moves one half on by a stream made from the other."""
    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    start = F.struct(text.substr(F.lit(1), u).alias("a"), text.substr(u + 1, n).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.length(s["a"]) / STREAM).cast("int"))
        stream = F.concat_ws("", F.transform(blocks, lambda k: _hmac(key, F.lit(tweak), i, k, n, F.lower(s["b"]))))
        return F.struct(s["b"].alias("a"), _shifted(s["a"], stream, hexadecimal).alias("b"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
    return F.concat(out["a"], out["b"])


def permute_classes(text: Column, key: str, tweak: str) -> Column:
    """Digits stay digits, letters stay letters of their case, the rest stays."""
    return _permuted(text, key, tweak)


def permute_hex(text: Column, key: str) -> Column:
    """Hexadecimal digits of any length; all upper case stays so."""
    new = _permuted(F.lower(text), key, "hex", hexadecimal=True)
    return F.when(text == F.lower(text), new).otherwise(F.upper(new))


def permute_date(day: Column, key: str) -> Column:
    """A date, permuted among the days of its century (92 x 397 or 75 x 487 of them)."""
    century = (F.floor(F.year(day) / 100) * 100).cast("int")
    first = F.make_date(century, F.lit(1), F.lit(1))
    leap = century % 400 == 0
    a, b = F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397)
    n = F.datediff(day, first)
    out = feistel(F.floor(n / b), n % b, a, b, key, century)
    return F.date_add(first, (out["a"] * b + out["b"]).cast("int"))


def _ends(m: Column, group: str, least: int, most: int) -> Column:
    """m, and what of it begins or ends with a border of groups and has so many characters (separators aside), longest first."""
    sizes = F.sequence(F.lit(most), F.lit(least), F.lit(-1))
    begin = lambda n: F.concat(F.lit(f"^(?:{group}[ -]?){{"), (n - 1).cast("string"), F.lit(f"}}{group}(?=[ -]|$)"))
    end = lambda n: F.concat(F.lit(f"(?:(?<=[ -])|^)(?:{group}[ -]?){{"), (n - 1).cast("string"), F.lit(f"}}{group}$"))
    part = lambda pattern: F.call_function("regexp_extract", m, pattern, F.lit(0))
    return F.filter(F.flatten(F.transform(sizes, lambda n: F.array(part(begin(n)), part(end(n))))), lambda x: x != "")


def _within(m: Column, parts: Column, valid, new) -> Column:
    """m with the first of its parts that is valid replaced; m as it is if none is."""
    one = F.get(F.filter(parts, valid), 0)
    at = F.call_function("instr", m, one)
    changed = F.concat(m.substr(F.lit(1), at - 1), new(one), m.substr(at + F.length(one), F.length(m)))
    return F.when(one.isNotNull(), changed).otherwise(m)


def _new_card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    core = permute_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
    return fill(m, F.concat(core, ((10 - luhn_sum(core, True) % 10) % 10).cast("string")))


def _new_iban(m: Column, key: str) -> Column:
    flat = F.regexp_replace(m, " ", "")
    body = permute_classes(flat.substr(F.lit(5), F.length(flat)), key, "iban")
    checks = F.lpad((98 - mod97(F.concat(body, flat.substr(1, 2), F.lit("00")))).cast("string"), 2, "0")
    letters = F.split(F.concat(flat.substr(1, 2), checks, body), "")
    return F.concat_ws("", F.zip_with(F.split(m, "[A-Z0-9]", -1), letters, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))))


def _is_iban(m: Column) -> Column:
    flat = F.regexp_replace(m, " ", "")
    return (F.length(flat) >= 15) & (mod97(F.concat(flat.substr(F.lit(5), F.length(flat)), flat.substr(1, 4))) == 1)


def _is_phone(m: Column) -> Column:
    """Ten digits after an optional 1, or with a + (or 00) and seven to fifteen, not all the same."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    count = F.length(digits)
    return F.when(F.startswith(m, F.lit("+")), count.between(7, 15)).when(F.startswith(m, F.lit("00")), count.between(9, 17)).otherwise(count.between(10, 11)) & ~digits.rlike(r"^([0-9])\1*$")


def pseudonym(m: Column, key: str) -> Column:
    """What a match becomes: itself where it does not validate."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    whole = lambda kind: m.rlike(f"^(?:{_bare(kind)})$")
    is_card = lambda x: luhn_sum(F.regexp_replace(x, "[^0-9]", ""), False) % 10 == 0
    card = _within(m, _ends(m, "[0-9]", 13, 19), is_card, lambda x: _new_card(x, key))
    groups = F.split(m, " ")
    heads = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda n: F.concat_ws(" ", F.slice(groups, F.lit(1), n)))
    iban = _within(m, heads, _is_iban, lambda x: _new_iban(x, key))
    octets = F.split(m, r"\.")
    valid_ip = F.forall(octets, lambda o: (o.cast("int") <= 255) & (o == o.cast("int").cast("string")))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda s, o: s * 256 + o.cast("bigint"))
    ip = feistel(F.floor(number / 65536), number % 65536, F.lit(65536), F.lit(65536), key, F.lit("ip"))
    dotted = F.concat_ws(".", *[F.floor(v / 256).cast("string") if high else (v % 256).cast("string") for v in (ip["a"], ip["b"]) for high in (True, False)])
    date = m
    # of 10/12/1999 the day is first, where both can be
    for sign, layout in (("-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy")):
        day = F.try_to_timestamp(m, F.lit(layout)).cast("date")
        date = F.when(F.contains(m, F.lit(sign)) & day.isNotNull() & (F.year(day) >= 1000), F.date_format(permute_date(day, key), layout)).otherwise(date)
    area, group, serial = digits.substr(1, 3), digits.substr(4, 2), digits.substr(6, 4)
    valid_ssn = ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    # 1-899 without 666, 1-99 and 1-9999, each counted from 0
    a0 = area.cast("int") - F.when(area.cast("int") > 666, 2).otherwise(1)
    ssn = feistel(a0, (group.cast("int") - 1) * 9999 + serial.cast("int") - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    a1 = ssn["a"] + F.when(ssn["a"] >= 665, 2).otherwise(1)
    new_ssn = F.concat_ws("-", F.lpad(a1.cast("string"), 3, "0"), F.lpad((F.floor(ssn["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((ssn["b"] % 9999 + 1).cast("string"), 4, "0"))
    head = F.regexp_extract(m, r"^(\+[0-9]{1,3}|00[0-9]{1,3}(?=[ .-])|1)?", 0)
    rest = m.substr(F.length(head) + 1, F.length(m))
    phone = F.concat(head, fill(rest, permute_digits(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return (
        F.when(F.contains(m, F.lit("@")), F.concat(permute_classes(local, key, "mail"), F.lit("@"), domain))
        .when(whole("iban"), iban)
        .when(whole("ipv4"), F.when(valid_ip, dotted).otherwise(m))
        .when(whole("date"), date)
        .when(whole("ssn"), F.when(valid_ssn, new_ssn).otherwise(m))
        .when(whole("phone"), F.when(_is_phone(m), phone).otherwise(m))
        .when(whole("ipv6"), fill_hex(m, permute_hex(F.regexp_replace(m, ":", ""), key)))
        .when(whole("card"), card)
        .when(m.rlike("^[0-9A-Fa-f]{16,}$"), permute_hex(m, key))
        .otherwise(permute_classes(m, key, "password"))  # no other kind is left
    )


def _bare(kind: str) -> str:
    """A kind's pattern without what it asks of the text around."""
    return re.sub(r"\(\?<?[!=](?:[^()\[\]]|\[[^\]]*\]|\((?:[^()]|\[[^\]]*\])*\))*\)", "", PATTERNS[kind])


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with `text` rewritten and n_found, n_replaced added."""
    maybe = F.col(text).rlike("[0-9@]")  # every pattern needs one
    found = F.when(maybe, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("__pii_found", found).withColumn("__pii_new", F.transform("__pii_found", lambda m: pseudonym(m, key)))
    gaps = F.split(F.col(text), ANY, -1)
    joined = F.concat_ws("", F.zip_with(gaps, "__pii_new", lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))))
    changed = F.size(F.filter(F.zip_with("__pii_found", "__pii_new", lambda a, b: a != b), lambda x: x))
    return (
        out.withColumn("n_found", F.coalesce(F.size("__pii_found"), F.lit(0)).cast("long"))
        .withColumn("n_replaced", F.greatest(changed, F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col("n_replaced") > 0, joined).otherwise(F.col(text)))
        .drop("__pii_found", "__pii_new")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pseudonymise(docs, session_key(spark))
    return done.select("doc_id", "n_found", "n_replaced", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")
