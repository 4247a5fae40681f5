"""Secret scans on DataFrame functions alone: fixed patterns, and sliding-window entropy for the rest.

A candidate is a run of at least ``WINDOW`` characters of the token alphabet. Its class (hex, letters of one case or of
both, letters and digits, or any token character) sets the entropy that one window of it must reach. The window slides one
character at a time: the counts of the character that leaves and the one that enters change by one, and with them
the running sum of n*log2(n) from which the entropy follows; the first window that reaches the bar ends the work. A
candidate is parted into characters once, so time is linear in its length. Candidates on the allow-list (joined
words, plain numbers, UUIDs, repeated characters, and stated placeholders) are suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import need, table

#: Fixed by the contract: kinds as listed, pattern, group that is measured, characters it must have.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Words without which no assignment matches; a cheap test that spares most texts the pattern.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
WINDOW = 20
#: The lookbehind keeps a match from starting inside a run.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Class, what its candidates look like, the bits that a window must reach, and fewer bits that are enough where the candidate
#: is drawn rather than written; the first class that fits counts. A window of 20 has at most 4.32 bits, of hex digits at
#: most 4. Long words of letters alone stay below 3.65.
CLASSES = (
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", 3.0, 2.9),
    ("letters", r"^([a-z]+|[A-Z]+)$", 3.65, 3.2),
    ("mixed", r"^[A-Za-z]+$", 3.65, 3.2),
    ("alnum", r"^[A-Za-z0-9]+$", 3.7, 3.4),
    ("token", r"", 3.9, 3.4),
)
#: Drawn characters show digits in several places, or many letters that words have few of: at least four, and an eighth of all.
SCATTERED = r"[0-9][^0-9]+[0-9].*[A-Za-z]|[A-Za-z].*[0-9][^0-9]+[0-9]"
RARE, RARE_LEAST, RARE_SHARE = "jqxzykwv", 4, 8
#: Groups repeat possessively: the engine then loops instead of descending once for each part of a long candidate. A joined
#: word is lower, upper or camel case with a short number behind it.
_WORD = r"(?:(?:[A-Z][a-z]++)++|[a-z]++|[A-Z]++)?+[0-9]{0,4}+"
ALLOWED = (
    r"^[0-9_=+/-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+[0-9]{1,4}$",
    rf"^{_WORD}(?:[-_/+=]{_WORD})++$",
    r"(.)\1{5}",
    r"(?i)abcdef0123456789",
    r"(?i)^[a-z_=-]*+(?<=example|examplekey|placeholder|changeme)$",
    r"EXAMPLE(?:KEY)?$",
)
#: Items that one inner pass appends to an array; keeps running sums linear in long texts.
STRIDE = 256


def _running(lengths: Column) -> Column:
    """Sums before each element, in blocks of STRIDE so that arrays are never copied once per element."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STRIDE).cast("int"))

    def block(state: Column, b: Column) -> Column:
        inner = F.aggregate(
            F.slice(lengths, b * STRIDE + 1, STRIDE),
            F.struct(F.array().cast("array<long>").alias("out"), state["at"].alias("at")),
            lambda s, n: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + n).alias("at")),
        )
        return F.struct(F.concat(state["out"], F.array(inner["out"])).alias("out"), inner["at"].alias("at"))

    start = F.struct(F.array().cast("array<array<long>>").alias("out"), F.lit(0).cast("long").alias("at"))
    total = F.aggregate(blocks, start, block, lambda s: F.flatten(s["out"]))
    return F.when(F.size(lengths) > 0, total).otherwise(F.array().cast("array<long>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, part>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    ends = F.transform(F.arrays_zip(_running(steps).alias("a"), steps.alias("s")), lambda x: x["a"] + x["s"])
    zipped = F.arrays_zip(ends.alias("e"), found.alias("m"), parts.alias("p"))
    return F.transform(
        zipped,
        lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), x["e"].alias("end"), x["p"].alias("part")),
    )


def reaches(token: Column, bits: Column, window: int = WINDOW) -> Column:
    """Whether ``window`` consecutive characters of ``token`` (at least that long) have a Shannon entropy of ``bits``."""

    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    # What depends on the whole token goes along in the state: in the step it would be worked out for every character.
    # An entropy of ``bits`` is a sum of n*log2(n) over the window's counts of at most this.
    most = window * (F.log2(F.lit(float(window))) - bits) + 1e-9
    start = F.split(F.substring(token, 1, window), "")
    every = F.split(token, "")
    many = F.length(token) - window
    first = F.aggregate(F.array_distinct(start), F.lit(0.0), lambda s, c: s + term(F.size(F.filter(start, lambda x: x == c))))
    counts = F.map_from_entries(F.transform(F.array_distinct(every), lambda c: F.struct(c, F.size(F.filter(start, lambda x: x == c)))))
    steps = F.zip_with(F.slice(every, F.lit(1), many), F.slice(every, F.lit(window + 1), many), lambda g, n: F.struct(g.alias("gone"), n.alias("new")))

    def slide(state: Column, step: Column) -> Column:
        gone, new = step["gone"], step["new"]
        out, into = F.element_at(state["counts"], gone), F.element_at(state["counts"], new)
        total = state["sum"] - term(out) + term(out - 1) - term(into) + term(into + 1)
        changed = F.transform_values(state["counts"], lambda k, n: n - (k == gone).cast("int") + (k == new).cast("int"))
        return F.when(state["hit"] | (gone == new), state).otherwise(held(changed, total, state["most"]))

    def held(counts: Column, total: Column, most: Column) -> Column:
        return F.struct(counts.alias("counts"), total.alias("sum"), most.alias("most"), (total <= most).alias("hit"))

    return F.aggregate(steps, held(counts, first, most), slide, lambda s: s["hit"])


def _at_least(n: int):
    return lambda m: F.length(m["part"]) >= n


def _suspicious(token: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | token.rlike(pattern)
    rare = F.length(F.regexp_replace(F.lower(token), f"[^{RARE}]", ""))
    drawn = token.rlike(SCATTERED) | ((rare >= RARE_LEAST) & (rare * RARE_SHARE >= F.length(token)))
    bar = F.when(drawn, F.lit(CLASSES[-1][3])).otherwise(F.lit(CLASSES[-1][2]))
    for _, pattern, bits, fewer in CLASSES[-2::-1]:
        bar = F.when(token.rlike(pattern), F.when(drawn, F.lit(fewer)).otherwise(F.lit(bits))).otherwise(bar)
    return ~allowed & reaches(token, bar)


def _joined(spans: Column, kinds: list[str]) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans to (doc_id, text).

    A very long text is scanned whole, in time linear in its length. Spans are kind:start:end by start, then kind as listed (entropy last), comma-joined; code points, end
    exclusive. Entropy spans may overlap base spans, which all stay. Null text counts as empty. Rows are judged one by one:
    repeated rows repeat their results, an empty table gives an empty one, other columns are not looked at.
    """
    need(docs, "doc_id", "text")
    kinds = [k for k, *_ in BASE] + ["entropy"]
    none = F.array().cast("array<struct<start:long,end:long,part:string>>")
    lower = F.lower("text")
    worth = {
        "assign": lower.contains(ASSIGN_WORDS[0]),
        "access": F.col("text").contains("AKIA"),
        "hex": F.col("text").rlike(BASE[2][1]),
        "entropy": F.col("text").rlike(CANDIDATE),
    }
    for word in ASSIGN_WORDS[1:]:
        worth["assign"] = worth["assign"] | lower.contains(word)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern, group, least in BASE:
        found = F.filter(matches(F.col("text"), pattern, group), _at_least(least))
        rows = rows.withColumn(kind, F.when(worth[kind], found).otherwise(none))
    tokens = F.filter(matches(F.col("text"), CANDIDATE), lambda m: _suspicious(m["part"]))
    rows = rows.withColumn("entropy", F.when(worth["entropy"], tokens).otherwise(none)).drop("text")

    def placed(kind: str) -> Column:
        k = kinds.index(kind) + 1
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    base = F.concat(*[placed(k) for k, *_ in BASE])
    rows = rows.withColumn("base", base)
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(_joined(F.col("base"), kinds), 256).alias("base_sha256"),
        _joined(F.concat("base", placed("entropy")), kinds).alias("spans"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
