"""PII pseudonyms: validated numbers, dates and addresses are permuted within their format by a keyed Feistel network.

Native DataFrame code only. Patterns find the candidates; each is validated (Luhn, mod 97, calendar, octets, number
ranges) and, if valid, replaced by another value of its format. The permutation depends on key and kind alone, so equal
values get equal pseudonyms in every document and different ones stay different. Cards, IBANs and phones are permuted
without their separators, so a value's pseudonym doesn't depend on how it is written.

A text is searched in layers: IBANs, cards in their usual groups, other cards, all other kinds. Only valid values are cut
out; what is between them is searched whole by the next layer. Runs of groups of digits (or of IBAN characters) may hold
several numbers: from each group on the longest valid sub-run that ends with a group is taken, and the search goes on after it.

The network works on a list of digits with a radix each (10 for digits, 26 for letters, 256 for octets, 1 for what stays).
In each round one half is shifted, digit by digit and modulo its radix, by SHA-256 of key, round and the other half; that
is a permutation for any radices. Check digits are computed anew. Dates walk the cycle until they lie between 1900 and 2099.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, unused

ROUNDS = 8
#: The lengths are those that the mail standards allow; without bounds a long domain would exhaust the matcher's stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
IBAN_RUN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?:[ -][A-Z0-9]++(?![a-z]))*+"
IBAN = r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:([ -])[A-Z0-9]{4}(?:\1[A-Z0-9]{4}){1,6})(?:\1[A-Z0-9]{1,4})?)$"
DATE = r"(?<![0-9/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
#: Numbers that end a run of digits. FEW: not before a phone that more digits follow than it can have.
OTHER = "|".join((DATE, SSN, IP))
FEW = r"(?!\+(?:[ .-]?[0-9]){16}|(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)(?:[ .-]?[0-9]){13})"
CARD_RUN = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{OTHER})[0-9]++)*+"
USUAL_CARD = r"^(?:[0-9]+|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
#: What is cut out, or kept whole, in the layers of IBANs, of cards and of all other kinds.
IBANS = f"{EMAIL}|{IBAN_RUN}"
CARDS = f"{EMAIL}|{OTHER}|{FEW}(?:{PHONE})|{CARD_RUN}"
OTHERS = f"{EMAIL}|{OTHER}|{PHONE}"
KINDS = ("email", "iban", "date", "ssn", "ip", "phone", "card")
FIRST_DAY, DAYS, A, B = "1900-01-01", 73049, 270, 271  # 270 * 271 = 73,170 >= 73,049 days


def feistel(digits: Column, radices: Column, key: str, kind: str) -> Column:
    """The keyed permutation of digits (array<bigint>), each below its radix."""

    def turn(state: Column, r: Column) -> Column:
        half = F.floor(F.size(state) / 2)
        mine = lambda i: (i < half) == (r % 2 == 0)
        other = F.array_join(F.transform(state, lambda x, i: F.when(mine(i), F.lit("")).otherwise(x.cast("string"))), ",")
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(state) / 9).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), b.cast("string"), other).cast("binary"), 256))

        def shifted(hashes: Column) -> Column:
            offset = lambda i: F.conv(F.substring(F.get(hashes, F.floor(i / 9).cast("int")), (i % 9) * 7 + 1, F.lit(7)), 16, 10).cast("bigint")
            return F.transform(state, lambda x, i: F.when(mine(i), (x + offset(i)) % F.get(radices, i)).otherwise(x))

        return let(blocks, shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), digits, turn)


def _in_place(m: Column, fixed, key: str, kind: str) -> Column:
    """m with its digits and letters permuted, each within its class; fixed(i): position i stays."""
    kinds = (("[0-9]", 48, 10), ("[a-z]", 97, 26), ("[A-Z]", 65, 26))

    def pick(c: Column, i: Column, make, other: Column) -> Column:
        out = F.when(fixed(i), other)
        for symbols, first, radix in kinds:
            out = out.when(c.rlike(symbols), make(first, radix))
        return out.otherwise(other)

    def permuted(chars: Column) -> Column:
        digits = F.transform(chars, lambda c, i: pick(c, i, lambda first, _: (F.ascii(c) - first).cast("bigint"), F.lit(0).cast("bigint")))
        radices = F.transform(chars, lambda c, i: pick(c, i, lambda _, radix: F.lit(radix).cast("bigint"), F.lit(1).cast("bigint")))
        return let(feistel(digits, radices, key, kind), lambda out: F.array_join(F.transform(chars, lambda c, i: pick(c, i, lambda first, _: F.char(F.get(out, i) + first), c)), ""))

    return let(F.split(m, ""), permuted)


def _bare(m: Column) -> Column:
    """m without its separators."""
    return F.regexp_replace(m, "[^0-9A-Za-z]", "")


def _laid_out(m: Column, new: Column) -> Column:
    """The characters of new in m's layout."""
    return F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(new, F.length(_bare(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum of a string of digits, the last one counting once."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48)), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Of the number that text spells, letters counting 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97))


def _card(m: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        body = let(F.length(digits), lambda n: _in_place(digits, lambda i: i == n - 1, key, "card").substr(F.lit(1), n - 1))  # all but the check digit
        return let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    return let(made(_bare(m)), lambda new: _laid_out(m, new))


def _is_card(m: Column) -> Column:
    return let(_bare(m), lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0))


def _iban(m: Column, key: str) -> Column:
    made = lambda b: let(_in_place(b, lambda i: i < 4, key, "iban"), lambda x: F.concat(F.substring(x, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 2), F.lit("00")))).cast("string"), 2, "0"), F.substring(x, F.lit(5), F.length(x))))
    return let(let(_bare(m), made), lambda new: _laid_out(m, new))


def _is_iban(m: Column) -> Column:
    return m.rlike(IBAN) & let(_bare(m), lambda b: F.length(b).between(15, 34) & (_mod97(F.concat(F.substring(b, F.lit(5), F.length(b)), F.substring(b, 1, 4))) == 1))


def _ip(m: Column, key: str) -> Column:
    first = lambda o: F.get(o, F.lit(0))
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))

    def made(o: Column) -> Column:
        usual = first(o).between(1, 223)
        base = F.when(usual, 1).otherwise(first(o))
        digits = F.transform(o, lambda x, i: F.when(i == 0, x - base).otherwise(x))
        radices = F.array(F.when(usual, 223).otherwise(1).cast("bigint"), *[F.lit(256).cast("bigint")] * 3)
        return F.array_join(F.transform(feistel(digits, radices, key, "ip"), lambda x, i: F.when(i == 0, x + base).otherwise(x).cast("string")), ".")

    valid = ~F.exists(F.split(m, r"\."), lambda x: (x.cast("int") > 255) | ((F.length(x) > 1) & x.startswith("0")))
    return F.when(valid, let(octets, made))


def _ssn(m: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        area = F.get(p, F.lit(0))
        digits = F.array(area - F.when(area > 666, 2).otherwise(1), F.get(p, F.lit(1)) - 1, F.get(p, F.lit(2)) - 1)
        radices = F.array(*[F.lit(x).cast("bigint") for x in (898, 99, 9999)])
        padded = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return let(feistel(digits, radices, key, "ssn"), lambda o: F.concat_ws("-", padded(F.get(o, F.lit(0)) + F.when(F.get(o, F.lit(0)) >= 665, 2).otherwise(1), 3), padded(F.get(o, F.lit(1)) + 1, 2), padded(F.get(o, F.lit(2)) + 1, 4)))

    return F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), let(F.transform(F.split(m, "-"), lambda x: x.cast("bigint")), made))


def _date(m: Column, key: str) -> Column:
    day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy"))
    style = F.when(m.contains("-"), 0).when(F.try_to_date(m, "dd/MM/yyyy").isNotNull(), 1).otherwise(2)
    index = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
    radices = F.array(F.lit(A).cast("bigint"), F.lit(B).cast("bigint"))
    step = lambda x: let(feistel(F.array(F.floor(x / B), x % B), radices, key, "date"), lambda o: F.get(o, F.lit(0)) * B + F.get(o, F.lit(1)))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(12)), step(index), lambda x, _: F.when(x >= DAYS, step(x)).otherwise(x))
    new = let(F.date_add(F.lit(FIRST_DAY).cast("date"), walked.cast("int")), lambda d: F.when(style == 0, F.date_format(d, "yyyy-MM-dd")).when(style == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
    return F.when((index >= 0) & (index < DAYS), new)


#: Country codes of one and of two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(m: Column, key: str) -> Column:
    made = lambda d: let(F.when(m.startswith("+"), F.length(F.regexp_extract(F.concat(F.lit("+"), d), COUNTRY, 0)) - 1).otherwise(0), lambda code: _in_place(d, lambda i: i < code, key, "phone"))
    return F.when(F.length(_bare(m)).between(7, 15), let(let(_bare(m), made), lambda new: _laid_out(m, new)))


def _email(m: Column, key: str) -> Column:
    at = F.locate("@", m)
    return F.concat(let(F.substring(m, F.lit(1), at - 1), lambda x: _in_place(x, lambda i: F.lit(False), key, "email")), F.substring(m, at, F.length(m)))


def kind_of(m: Column) -> Column:
    """The kind of a match of OTHERS, by its shape."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|/"), "date")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip").otherwise("phone")
    )


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a match of OTHERS, or null if it isn't valid."""
    make = {"email": _email, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone}
    kind = kind_of(m)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k in make:
        out = out.when(kind == k, make[k](m, key))
    return out


PART = "struct<kind:string,m:string,new:string>"


def _part(m: Column, kind: Column | None = None, new: Column | None = None) -> Column:
    """A piece of text; new is null in what isn't replaced."""
    null = F.lit(None).cast("string")
    return F.struct((null if kind is None else kind).alias("kind"), m.alias("m"), (null if new is None else new).alias("new"))


def _one(m: Column, key: str) -> Column:
    return F.array(_part(m, kind_of(m), pseudonym(m, key)))


def _groups(m: Column, kind: str, lengths, valid, make, key: str) -> Column:
    """Parts of a run of groups: its valid sub-runs of so many groups, from the left, the longest first, and the rest."""
    bare_end = lambda x: F.regexp_replace(x, "[ -]$", "")
    end = lambda x: F.get(x, F.lit(0)) + F.get(x, F.lit(1))

    def cut(groups: Column) -> Column:
        joined = lambda start, n: F.array_join(F.slice(groups, start + 1, n), "")

        def longest(i: Column) -> Column:
            out = F.lit(0)
            for n in sorted(lengths):
                out = F.when((i + n <= F.size(groups)) & let(bare_end(joined(i, F.lit(n))), valid), F.lit(n)).otherwise(out)
            return out

        nothing = F.expr("array()").cast("array<array<int>>")
        taken = F.aggregate(
            F.sequence(F.lit(0), F.size(groups) - 1), F.struct(F.lit(0).alias("next"), nothing.alias("all")),
            lambda a, i: F.when(i < a["next"], a).otherwise(let(longest(i), lambda n: F.when(n > 0, F.struct((i + n).alias("next"), F.concat(a["all"], F.array(F.array(i, n))).alias("all"))).otherwise(a))),
            lambda a: a["all"],
        )

        def parts(all_taken: Column) -> Column:
            before = lambda k: F.when(k == 0, F.lit(0)).otherwise(end(F.get(all_taken, k - 1)))

            def both(x: Column, k: Column) -> Column:
                found = joined(F.get(x, F.lit(0)), F.get(x, F.lit(1)))
                made = let(found, lambda f: let(bare_end(f), lambda b: F.array(_part(b, F.lit(kind), make(b, key)), _part(F.substring(f, F.length(b) + 1, F.lit(1))))))
                return F.concat(F.array(_part(joined(before(k), F.get(x, F.lit(0)) - before(k)))), made)

            rest = let(end(F.element_at(all_taken, -1)), lambda e: joined(e, F.size(groups) - e))
            return F.when(F.size(all_taken) > 0, F.concat(F.flatten(F.transform(all_taken, both)), F.array(_part(rest)))).otherwise(F.array(_part(m)))

        return let(taken, parts)

    return let(F.regexp_extract_all(m, F.lit("[A-Z0-9]+[ -]?"), F.lit(0)), cut)


def _ibans(m: Column, key: str) -> Column:
    # at most 4 + 30 characters: 9 groups
    return F.when(m.contains("@"), F.array(_part(m))).otherwise(_groups(m, "iban", range(1, 10), _is_iban, _iban, key))


def _cards(usual: bool):
    lengths, valid = ((1, 3, 4, 5), lambda m: m.rlike(USUAL_CARD) & _is_card(m)) if usual else (range(2, 20), _is_card)

    def judge(m: Column, key: str) -> Column:
        return F.when(m.rlike("^[0-9 -]{13,}$") & ~m.rlike(f"^(?:{OTHER})$"), _groups(m, "card", lengths, valid, _card, key)).otherwise(F.array(_part(m)))

    return judge


def _layer(parts: Column, pattern: str, judge, key: str) -> Column:
    """parts with the valid matches in those that aren't replaced yet cut out; the text between them stays whole."""

    def cut(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: judge(m, key))
        none = F.expr("array()").cast(f"array<{PART}>")
        pieces = F.flatten(F.zip_with(F.split(t, pattern, -1), found, lambda p, x: F.concat(F.array(_part(p)), F.coalesce(x, none))))
        return let(pieces, lambda all_: let(F.filter(F.transform(all_, lambda x, i: F.when(x["new"].isNotNull(), i)), lambda i: i.isNotNull()), lambda ok: merged(t, all_, ok)))

    def merged(t: Column, pieces: Column, ok: Column) -> Column:
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(ok, k - 1) + 1)
        plain = lambda a, b: F.array(_part(F.array_join(F.transform(F.slice(pieces, a + 1, b - a), lambda x: x["m"]), "")))
        upto = F.flatten(F.transform(ok, lambda e, k: F.concat(plain(start(k), e), F.array(F.get(pieces, e)))))
        return F.when(F.size(ok) == 0, F.array(_part(t))).otherwise(F.concat(upto, plain(start(F.size(ok)), F.size(pieces))))

    return F.flatten(F.transform(parts, lambda s: F.when(s["new"].isNull() & s["m"].rlike(pattern), cut(s["m"])).otherwise(F.array(s))))


LAYERS = ((IBANS, _ibans), (CARDS, _cards(True)), (CARDS, _cards(False)), (OTHERS, _one))


def pseudonymize(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """docs with every valid value in text replaced by its pseudonym, and n_pii and n_<kind> of them (long).

    Null texts stay null and count 0; texts of any length are searched whole, rows that repeat each; no rows give none; invalid look-alikes (a card that fails its checksum, 30 February) stay as they are.
    Columns with the names of the counts are replaced, no others. key: the secret that the pseudonyms depend on; whoever
    knows it can undo them, so it has no default.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    t, (name,) = F.col(text), unused(docs, "found")
    out = docs.withColumn(name, F.when(t.rlike("[0-9@]"), F.array(_part(t))).otherwise(F.expr("array()").cast(f"array<{PART}>")))
    for pattern, judge in LAYERS:
        out = out.withColumn(name, _layer(F.col(name), pattern, judge, key))
    valid = F.filter(name, lambda x: x["new"].isNotNull())
    count = lambda k: F.size(F.filter(valid, lambda x: x["kind"] == k)).cast("bigint")
    if counts:
        out = out.withColumns({f"n_{k}": count(k) for k in KINDS} | {"n_pii": F.size(valid).cast("bigint")})
    renewed = F.array_join(F.transform(name, lambda x: F.coalesce(x["new"], x["m"])), "")
    return out.withColumn(text, F.when(F.size(valid) > 0, renewed).otherwise(t)).drop(name)


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.factorlab.pseudonymKey; where that is unset, a public one, for demonstration only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, spark.conf.get("spark.factorlab.pseudonymKey", "demonstration"))
