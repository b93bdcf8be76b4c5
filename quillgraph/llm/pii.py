"""Format-preserving pseudonyms for personal data.

Validated numbers and dates go through a keyed Feistel permutation of their own
format: card numbers (the check digit is made anew), phone numbers, social
security numbers, IPv4 addresses, dates of 1900-2099.  Equal values get equal
pseudonyms in every document, different values different ones, and the holder of
the key can turn them back.  yyyy-MM-dd and MM/dd/yyyy move a day alike; dd/MM/yyyy is what cannot be read
with the month first, and stays so.  Mail addresses have no fixed format to permute; they
become a keyed digest at a reserved domain.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillgraph.functions.arrays import bind
from quillgraph.llm.textkit import spread

ROUNDS = 10

# Formats.  Look-arounds keep a match from starting or ending inside a longer number.
EMAIL = r"(?<![A-Za-z0-9_%+])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
DATE = r"(?<![\d/-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d)(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?<!\d[.-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|-\d)"
#: A whole run of digit groups, in which cards are looked for; it ends before a value that reaches beyond the run.
CARD = (rf"(?<!\d)\d(?:\d|[ -](?!{EMAIL}|{IPV4}|\d\d/\d\d/(?:19|20)\d\d(?![\d/-])|(?=[\d -]{{3,10}}\.){PHONE})\d){{12,}}+")
#: What a run may hold beside cards, and how cards are usually written.
INSIDE = "|".join(f"(?:{p})" for p in (DATE, SSN, PHONE))
USUAL = r"^[ -]?(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{3}\3\d{3}\3\d{3})$"
#: Earlier formats win where two begin at one place.
KINDS = {"email": EMAIL, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())

DAYS = 73_049          # days of 1900-2099
DAY_HALVES = (271, 270)
FIRST_DAY = "1900-01-01"
WALK = 64              # most steps of a cycle walk; one in over 10**40 walks would need more


def feistel(value: Column, halves: tuple[Column | int, Column | int], key: str, kind: str) -> Column:
    """Keyed permutation of 0 .. halves[0]*halves[1]-1.

    The halves add a keyed digest of the other one, in turn, over an even number of rounds.
    """
    left, right = (F.lit(h).cast("long") if isinstance(h, int) else h.cast("long") for h in halves)

    def step(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, left).otherwise(right)
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), left.cast("string"), i.cast("string"), s["b"].cast("string")), 256)
        added = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(added, size), size).alias("b"))

    # Whole-number division: a quotient in doubles would round above 2**53.
    start = F.struct(F.call_function("div", value, right).alias("a"), F.pmod(value, right).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * right + s["b"])


def walk(value: Column, permute: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """Permute again and again until the result is valid: a permutation of the valid values."""
    start = F.struct(permute(value).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.when(
        valid(s["v"]), s).otherwise(F.struct(permute(s["v"]).alias("v"))), lambda s: s["v"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _fill(shape: Column, digits: Column) -> Column:
    """Put digits, in order, in the places of the digits of ``shape``."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(F.split(shape, ""), state, lambda s, c: F.when(
        c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; every second digit from the right is doubled, from the one ``doubled`` places in."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, d: a + d)


def _cards(run: Column, form: Callable[[Column, Column], Column]) -> Column:
    """Cut a run of digit groups into parts (old, kind); kind is ``card`` for cards and null for the rest.

    Every sub-run of whole groups with 13 to 19 digits, a right check digit and the
    ``form`` is a card; the leftmost wins, then the longest.
    """
    def cut(groups: Column) -> Column:
        text = lambda at, k: F.array_join(F.slice(groups, at + 1, k), "")

        def is_card(sub: Column) -> Column:
            return bind(_digits(sub), lambda d: F.length(d).between(13, 19) & form(sub, run) & (luhn_sum(d, 1) % 10 == 0))

        def at_group(_: Column, i: Column) -> Column:
            sizes = F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i))
            fits = F.filter(sizes, lambda k: is_card(text(i, k)))
            return F.struct(i.alias("at"), F.coalesce(F.array_max(fits), F.lit(0)).alias("k"))

        begins = F.filter(F.transform(groups, at_group), lambda c: c["k"] > 0)
        start = F.struct(F.lit(0).alias("free"), F.slice(begins, 1, 0).alias("taken"))
        taken = F.aggregate(begins, start, lambda s, c: F.when(c["at"] < s["free"], s).otherwise(
            F.struct((c["at"] + c["k"]).alias("free"), F.concat(s["taken"], F.array(c)).alias("taken"))), lambda s: s["taken"])

        def parts(cards: Column) -> Column:
            end = lambda c: F.coalesce(c["at"] + c["k"], F.lit(0))
            before = lambda i: end(F.get(cards, i - 1))
            rest = lambda a, b: F.struct(text(a, b - a).alias("old"), F.lit(None).cast("string").alias("kind"))
            pairs = F.transform(cards, lambda c, i: F.array(
                rest(before(i), c["at"]), F.struct(text(c["at"], c["k"]).alias("old"), F.lit("card").alias("kind"))))
            last = F.array(rest(before(F.size(cards)), F.size(groups)))
            return F.filter(F.concat(F.flatten(pairs), last), lambda p: p["old"] != "")

        return bind(taken, parts)

    return bind(F.regexp_extract_all(run, F.lit(r"[ -]?\d+|[ -]"), F.lit(0)), cut)


def _run(run: Column) -> Column:
    """Parts (old, kind) of a run of digit groups.

    First cards in a usual form or filling the run, then dates, social security and
    phone numbers in what is left, then cards in any form.
    """
    def others(rest: Column) -> Column:
        found = F.concat(F.regexp_extract_all(rest, F.lit(INSIDE), F.lit(0)), F.array(F.lit("")))
        pairs = F.zip_with(F.split(rest, INSIDE, -1), found, lambda gap, m: F.concat(
            _cards(gap, lambda sub, _: F.lit(True)),
            F.array(F.struct(m.alias("old"), F.when(m != "", kind_of(m)).alias("kind")))))
        return F.flatten(pairs)

    usual = _cards(run, lambda sub, whole: (sub == whole) | sub.rlike(USUAL))
    return F.flatten(F.transform(usual, lambda p: F.when(p["kind"].isNull(), others(p["old"])).otherwise(F.array(p))))


def _card(text: Column, key: str) -> Column:
    def of(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        size = F.length(digits) - 1
        low = (F.pow(F.lit(10.0), F.floor(size / 2))).cast("long")
        high = (F.pow(F.lit(10.0), size - F.floor(size / 2))).cast("long")
        moved = F.lpad(feistel(body.cast("long"), (high, low), key, "card").cast("string"), size, "0")
        return bind(moved, lambda m: _fill(text, F.concat(m, F.pmod(10 - luhn_sum(m, 0) % 10, F.lit(10)).cast("string"))))

    return bind(_digits(text), of)


def _number(text: Column, key: str, kind: str, size: int, valid: Callable[[Column], Column] | None = None) -> Column:
    """Permute the last ``size`` digits of a number and keep the rest of its form."""
    def of(digits: Column) -> Column:
        extra = F.substring(digits, F.lit(1), F.length(digits) - size)
        value = F.substring(digits, F.length(digits) - (size - 1), F.lit(size)).cast("long")
        permute = lambda v: feistel(v, (10 ** (size - size // 2), 10 ** (size // 2)), key, kind)
        moved = walk(value, permute, valid) if valid else permute(value)
        done = F.concat(extra, F.lpad(moved.cast("string"), size, "0"))
        return F.when(valid(value), bind(done, lambda d: _fill(text, d))).otherwise(text) if valid else bind(done, lambda d: _fill(text, d))

    return bind(_digits(text), of)


def _valid_ssn(v: Column) -> Column:
    area = F.floor(v / 1_000_000)
    return (area > 0) & (area != 666) & (area < 900) & (F.floor(v / 10_000) % 100 > 0) & (v % 10_000 > 0)


def _ipv4(text: Column, key: str) -> Column:
    value = F.aggregate(F.split(text, r"\."), F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    back = lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return bind(feistel(value, (65_536, 65_536), key, "ipv4"), back)


def _date(text: Column, key: str) -> Column:
    permute = lambda v: feistel(v, DAY_HALVES, key, "date")
    day_of = lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))
    known = lambda v: v < DAYS
    # A day up to 12 before the month would be read as a month: these dates are permuted among themselves.
    late = lambda v: (v < DAYS) & (F.dayofmonth(day_of(v)) > 12)

    def in_form(form: str, valid: Callable[[Column], Column]) -> Column:
        number = lambda d: F.datediff(d, F.lit(FIRST_DAY).cast("date")).cast("long")
        return bind(F.try_to_date(text, form), lambda d: F.when(
            d.isNotNull(), F.date_format(day_of(walk(number(d), permute, valid)), form)))

    return F.coalesce(in_form("yyyy-MM-dd", known), in_form("MM/dd/yyyy", known), in_form("dd/MM/yyyy", late), text)


def _email(text: Column, key: str) -> Column:
    return F.concat(F.lit("user"), F.substring(F.sha2(F.concat(F.lit(key + "|email|"), F.lower(text)), 256), 1, 12), F.lit("@example.org"))


def kind_of(match: Column) -> Column:
    """Which format a match of ``ANY`` has."""
    out = F.when(match.contains("@"), "email").when(match.rlike(rf"^(?:{IPV4})$"), "ipv4")
    for kind in ("date", "ssn", "phone"):
        out = out.when(match.rlike(rf"^(?:{KINDS[kind]})$"), kind)
    return out.otherwise("card")


def parts_of(match: Column) -> Column:
    """Parts (old, kind) of a match of ``ANY``: itself, or what is found in a run of digits."""
    return bind(kind_of(match), lambda kind: F.when(kind == "card", _run(match)).otherwise(
        F.array(F.struct(match.alias("old"), kind.alias("kind")))))


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """Pseudonym of a value; one that fails its check, or has no kind, stays as it is."""
    return (
        F.when(kind == "email", _email(match, key)).when(kind == "ipv4", _ipv4(match, key))
        .when(kind == "date", _date(match, key)).when(kind == "ssn", _number(match, key, "ssn", 9, _valid_ssn))
        .when(kind == "phone", _number(match, key, "phone", 10)).when(kind == "card", _card(match, key)).otherwise(match))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replace personal data in every whole text and count the replacements by kind.

    Adds ``n_<kind>`` (long) and replaces ``text``; columns of those names are replaced.
    Null texts stay null with counts of 0; texts without personal data come back
    unchanged.  Rows are independent of each other: no shuffle.
    """
    found = F.when(F.col(text).rlike(r"[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    marked = spread(docs).withColumn("_found", found).withColumn("_swaps", F.when(
        F.size("_found") > 0, F.transform("_found", lambda m: F.transform(parts_of(m), lambda p: F.struct(
            p["old"].alias("old"), p["kind"].alias("kind"), pseudonym(p["old"], p["kind"], key).alias("new"))))))
    gaps = F.split(F.col(text), ANY, -1)
    news = F.concat(F.transform("_swaps", lambda s: F.array_join(F.transform(s, lambda p: p["new"]), "")), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(gaps, news, lambda g, n: F.concat(g, n)), "")
    swapped = lambda kind: F.coalesce(F.size(F.filter(F.flatten("_swaps"), lambda s: (
        s["kind"] == kind) & (s["new"] != s["old"]))), F.lit(0))
    counts = {f"n_{kind}": F.greatest(swapped(kind), F.lit(0)).cast("long") for kind in KINDS}
    return marked.withColumns({**counts, text: F.when(F.size("_swaps") > 0, rebuilt).otherwise(F.col(text))}).drop("_found", "_swaps")
