"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Candidates are runs of at least `WINDOW` characters of the base-64 and URL alphabets, with `=` only as padding at the end,
so that name=value is two. A run of hexadecimal digits is of class hex, one that mixes capitals, small letters and digits
of class b64; one without capitals that has `WINDOW` small letters and digits in a row is of class lower, one without
small letters alike of class upper; others are no candidates. A window of `WINDOW`
characters slides over the candidate; the counts of its characters and the sum of n * log2(n) change by the character
that leaves and the one that enters. From the first to the last window whose Shannon entropy reaches the class's
threshold the string is a span, unless the allow list explains it: UUIDs, placeholders, alphabets, paths without capitals, or a label
such as `sha256` or `commit` right before it. Spans within one of a fixed pattern are not added again.

Everything is a column expression over one row, so nothing is shuffled. Places are in code points, end exclusive. The
work is in proportion to the text, whatever its number of matches.

Defined results: null and empty texts have no spans and the digest of the empty string. Repeated rows are scanned alike.
Very long texts are scanned whole. An empty table gives no rows. `scan` adds base and added, in place of columns of those
names; other columns stay, `digest` reads doc_id and text alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import last_at_most, matches, running
from .pseudonyms import let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}|[A-Za-z0-9+/_-]{19}={1,2}|[A-Za-z0-9+/_-]{18}=="
#: Bits per character; a random hexadecimal window has about 3.3, a random base-64 one about 4.1, one of 36 letters and digits 3.8, words below 3.6.
LEAST_BITS = {"entropy_hex": 2.9, "entropy_b64": 3.8, "entropy_lower": 3.6, "entropy_upper": 3.6}
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i:example|sample|placeholder|changeme|dummy|xxxx|0123456789|abcdefghij)"
    r"|^/?[a-z0-9_-]+(/[a-z0-9_-]+){2,}/?$"
)
ALLOWED_BEFORE = r"""(?i)(sha-?[0-9]*|md5|commit|checksum|digest|integrity|etag|uuid)["']?[\s:=-]{1,3}["']?$"""
#: The candidate alphabet lies between these code points.
FIRST, SIZE = 43, 80


def _bits_sum(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def hot_range(text: Column, least_bits: Column) -> Column:
    """struct<lo, hi>: from the first window of at least so many bits per character to the end of the last; nulls if none."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - (FIRST - 1))
    # An array of one, so that the codes are computed once and not at every step.
    return F.element_at(F.transform(F.array(codes), lambda c: _hot_range(c, least_bits)), 1)


def _hot_range(codes: Column, least_bits: Column) -> Column:
    w = WINDOW
    at = lambda counts, code: F.element_at(counts, code)
    shift = lambda counts, code, by: F.transform(counts, lambda n, k: F.when(k + 1 == code, n + by).otherwise(n))
    first = F.aggregate(F.slice(codes, 1, w), F.array_repeat(F.lit(0), SIZE), lambda counts, c: shift(counts, c, 1))
    total = F.aggregate(first, F.lit(0.0), lambda s, n: s + _bits_sum(n))
    hot = lambda s: F.lit(w).cast("double") * (F.log2(F.lit(float(w))) - least_bits) >= s

    def slide(st: Column, i: Column) -> Column:
        out, into = F.element_at(codes, i), F.element_at(codes, i + w)
        n_out, n_in = at(st["counts"], out), at(st["counts"], into)
        moved = st["s"] - _bits_sum(n_out) + _bits_sum(n_out - 1) - _bits_sum(n_in) + _bits_sum(n_in + 1)
        same = out == into
        s = F.when(same, st["s"]).otherwise(moved)
        counts = F.when(same, st["counts"]).otherwise(shift(shift(st["counts"], out, -1), into, 1))
        lo = F.coalesce(st["lo"], F.when(hot(s), i))
        return F.struct(counts.alias("counts"), s.alias("s"), lo.alias("lo"), F.when(hot(s), i + w).otherwise(st["hi"]).alias("hi"))

    start = F.struct(first.alias("counts"), total.alias("s"), F.when(hot(total), F.lit(0)).alias("lo"), F.when(hot(total), F.lit(w)).alias("hi"))
    steps = F.when(F.size(codes) > w, F.sequence(F.lit(1), F.size(codes) - w)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, slide, lambda st: F.struct(st["lo"].alias("lo"), st["hi"].alias("hi")))


def _span(kind: str | Column, rank: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), end.alias("end"))


def scan(docs: DataFrame) -> DataFrame:
    """`docs` with base and added: arrays of struct<start, rank, kind, end> in order of start, then kind."""
    text = F.coalesce("text", F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    plain = lambda found, kind, rank: F.transform(found, lambda m: _span(kind, rank, m["start"], m["end"]))
    # Short assignments are dropped after matching: they use up their text like others.
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(value(m["match"])) >= 8)
    access = F.filter(matches(text, ACCESS), lambda m: F.length(m["match"]) >= 16)
    base = F.array_sort(F.concat(plain(assign, "assign", 0), plain(access, "access", 1), plain(matches(text, HEX), "hex", 2)))

    is_hex = lambda m: m.rlike("^[0-9a-fA-F]+$") & m.rlike("[0-9]") & m.rlike("[a-fA-F]")
    is_mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    in_a_row = lambda m, letters: m.rlike(f"[{letters}0-9]{{{WINDOW},}}") & m.rlike(f"[{letters}]") & m.rlike("[0-9]")
    is_lower = lambda m: in_a_row(m, "a-z") & ~m.rlike("[A-Z]")
    is_upper = lambda m: in_a_row(m, "A-Z") & ~m.rlike("[a-z]")
    kind = lambda m: F.when(is_hex(m), "entropy_hex").when(is_mixed(m), "entropy_b64").when(is_lower(m), "entropy_lower").when(is_upper(m), "entropy_upper")
    bits = lambda kind: F.element_at(F.create_map(*[F.lit(x) for pair in LEAST_BITS.items() for x in pair]), kind)
    classed = F.transform(matches(text, CANDIDATE), lambda m: F.struct(m["start"].alias("at"), m["match"].alias("match"), m["before"].alias("before"), kind(m["match"]).alias("kind")))
    suspect = F.filter(classed, lambda m: m["kind"].isNotNull() & ~m["match"].rlike(ALLOWED) & ~F.right(m["before"], F.lit(24)).rlike(ALLOWED_BEFORE))
    rated = F.transform(suspect, lambda m: F.struct(m["at"], m["kind"], hot_range(m["match"], bits(m["kind"])).alias("hot")))
    spans = F.transform(F.filter(rated, lambda m: m["hot"]["lo"].isNotNull()), lambda m: _span(m["kind"], 3, m["at"] + m["hot"]["lo"], m["at"] + m["hot"]["hi"]))
    found = docs.withColumn("base", base).withColumn("spans_by_entropy", spans)
    # A span lies in a fixed one if of those that start no later one ends no earlier.
    reach = running(F.transform("base", lambda b: b["end"]), F.greatest, F.lit(0))
    known = lambda ends, a: F.coalesce(F.get(ends, last_at_most(F.col("base"), lambda b: b["start"], a["start"])) >= a["end"], F.lit(False))
    return found.withColumn("added", let(reach, lambda ends: F.filter("spans_by_entropy", lambda a: ~known(ends, a)))).drop("spans_by_entropy")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id with the number of spans of each fixed kind, their digest, and all spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = scan(docs.select("doc_id", "text"))
    every = joined(F.array_sort(F.concat("base", "added")))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), every.alias("spans"))
