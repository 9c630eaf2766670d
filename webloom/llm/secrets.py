"""Secret scans in DataFrame expressions only: fixed forms, and strings that look random.

Fixed forms are regular expressions. Spark gives a pattern's matches and the text between them but no positions; both
lists together give every position exactly, in code points, by running sums.

Strings without a fixed form are judged by two character Markov models, one of random strings and one of ordinary
identifiers, both estimated from labelled samples: a run of key characters is a secret if its log-likelihood ratio is
high, in total and a transition. Runs inside a fixed form are left to it; those that reach beyond one are spans of their own.

Defined results. Null text: as an empty one, no spans. Empty table: no rows. Null, repeated and clashing ids: a row each.
Very long texts are scanned whole. Other columns are ignored, unless `redact_secrets` carries them on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The forms, in the order in which kinds are listed, with the least length of what decides.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")

#: A run of these may be a key. Its characters' places (from 1) number the states; 0 is a run's edge.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_RATIO, LEAST_RATIO_EACH = 12.0, 0.45
SMOOTHING = 0.5
#: Words of which the sample of ordinary identifiers is made.
ORDINARY = """
account action active address after apply archive array assert async backup balance base batch before branch buffer build button
cache center change channel character check client clone cluster code collection comment commit compare complete component context
control convert copy count database date decode default define design detail device dialog directory domain download editor
element email entry error event example exception factory feature field file filter format forward frame function future graph
group handle header height image import index initial input integer interface internal item iterator length level library limit
link location logger manager mapping master menu merge message method minimum monitor network normal notify number operation
option order origin output parameter parent parse partition path permission person phone picture plugin preview previous primary
print private program project property protocol provider random range reader receive record register release remote remove render
request reset resource response result root router runtime sample schedule scroll search section security select service session
setting shadow share snapshot socket source space special state static status storage stream success support switch symbol system
template terminal test theme thread token tracker traffic transaction transfer update upload user utility validate version view
visible volume warning wrapper write zone
"""
SPAN = "struct<start:int,kind_no:int,end:int>"


def default_samples(spark: SparkSession, random_strings: int = 4000) -> DataFrame:
    """(sample, random): digests in several alphabets, and names of one to three ordinary words in common spellings."""
    seeds = spark.range(random_strings)
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 512)
    kind = F.pmod("id", F.lit(4))
    random = seeds.select(
        F.when(kind == 0, F.substring(digest, 1, 40))
        .when(kind == 1, F.regexp_replace(F.base64(F.unhex(digest)), "\\s", ""))
        .when(kind == 2, F.substring(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""), 1, 40))
        .otherwise(F.substring(F.regexp_replace(F.upper(F.base64(F.unhex(digest))), "[^A-Z0-9]", ""), 1, 32))
        .alias("sample"),
        F.lit(True).alias("random"),
    )
    ordinary = ORDINARY.split()
    pairs = list(zip(ordinary, ordinary[7:] + ordinary[:7], ordinary[31:] + ordinary[:31]))
    spelled = [x for a, b, c in pairs for x in (a, f"{a}_{b}", f"{a}-{b}-{c}", a + b.capitalize() + c.capitalize(), f"{a}/{b}/{c}", (a + b + c).lower(), f"{a}_{b}".upper(), a.lower() + "2024")]
    named = spark.createDataFrame([(x, False) for x in spelled], "sample string, random boolean")
    return random.unionByName(named)


def train(samples: DataFrame, sample: str = "sample", random: str = "random") -> list[float]:
    """Log-likelihood ratio of each transition, by state * states + state, from labelled samples (null samples and labels are left out)."""
    states = len(SIGNS) + 1
    run = samples.select(F.col(random).alias("random"), F.concat(F.lit(" "), F.col(sample), F.lit(" ")).alias("run")).where("random is not null and run is not null")
    place = F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("i")
    steps = run.select("random", "run", place).select("random", F.instr(F.lit(SIGNS), F.col("run").substr(F.col("i"), F.lit(1))).alias("a"), F.instr(F.lit(SIGNS), F.col("run").substr(F.col("i") + 1, F.lit(1))).alias("b"))
    seen = {(r["random"], r["a"], r["b"]): r["n"] for r in steps.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}  # 2 * states**2 rows at most

    def logs(label: bool) -> list[float]:
        out = []
        for a in range(states):
            counts = [seen.get((label, a, b), 0) + SMOOTHING for b in range(states)]
            out += [math.log(n / sum(counts)) for n in counts]
        return out

    return [r - o for r, o in zip(logs(True), logs(False))]


def _ratio(run: Column, weights: list[float]) -> Column:
    """Log-likelihood ratio of a run, from its first sign to its last."""
    table = F.expr(f"cast(split('{','.join(f'{w:.5f}' for w in weights)}', ',') as array<double>)")  # foldable: one constant in the plan
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(SIGNS), c))  # once through the run, however long
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))

    def step(acc: Column, code: Column) -> Column:
        weight = F.when(acc["last"] == 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * (len(SIGNS) + 1) + code))
        return F.struct((acc["sum"] + weight).alias("sum"), code.alias("last"))

    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


def _spans(text: Column, pattern: str, kind: int, keep, gate: str | None = None) -> Column:
    """array<SPAN> of a pattern's leftmost non-overlapping matches that `keep(match)` wants; no work beyond one search where `gate` finds nothing."""
    none = F.array().cast(f"array<{SPAN}>")
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})") if pattern != ASSIGN else F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        begin = acc["at"] + F.coalesce(piece["gap"], F.lit(0))
        end = begin + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind_no"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.coalesce(keep(piece["hit"]), F.lit(False)), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(gate or pattern), F.aggregate(pieces, start, step, lambda acc: acc["found"])).otherwise(none)


def base_spans(text: Column) -> Column:
    """array<SPAN> of the fixed forms, by start, then kind."""
    value = F.regexp_extract
    found = [
        _spans(text, ASSIGN, 0, lambda hit: F.length(value(hit, ASSIGN, 1)) >= LEAST_ASSIGN),
        _spans(text, ACCESS, 1, lambda hit: F.length(hit) >= LEAST_ACCESS),
        _spans(text, HEX, 2, lambda hit: F.length(hit) >= LEAST_HEX, gate=f"[0-9a-f]{{{LEAST_HEX}}}"),
    ]
    return F.array_sort(F.concat(*found))


def random_spans(text: Column, weights: list[float]) -> Column:
    """array<SPAN> of runs that the models take for random strings."""

    def wanted(hit: Column) -> Column:
        ratio = _ratio(hit, weights)
        return ratio >= F.greatest(F.lit(LEAST_RATIO), F.length(hit) * LEAST_RATIO_EACH)

    return _spans(text, RUN, 3, wanted)


def joined_spans(base: Column, random: Column) -> Column:
    """All fixed forms, and the random runs that reach beyond any of them."""
    apart = F.filter(random, lambda r: ~F.exists(base, lambda b: (b["start"] <= r["start"]) & (r["end"] <= b["end"])))
    return F.when(F.size(random) == 0, base).otherwise(F.array_sort(F.concat(base, apart)))


def all_spans(text: Column, weights: list[float]) -> Column:
    return joined_spans(base_spans(text), random_spans(text, weights))


def find_secrets(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, base, spans): arrays of structs start, kind_no (into KINDS), end; code points, end exclusive. One pass over the rows, no shuffle."""
    whole = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = whole.withColumn("base", base_spans(F.col("text"))).withColumn("random", random_spans(F.col("text"), weights))
    return base.select(key, "text", "base", joined_spans(F.col("base"), F.col("random")).alias("spans"))


def span_list(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == KINDS.index(kind))).cast("bigint")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by `mark`; spans that overlap give one mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        fresh = F.array(F.substring(text, acc["at"] + 1, span["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], span["end"]).alias("at"), F.when(span["start"] >= acc["at"], F.concat(acc["out"], fresh)).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))


def redact_secrets(docs: DataFrame, weights: list[float], text: str = "text", length: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows with every secret of the text replaced by `mark`, and with the column `length`, if there is one, counted anew where
    the text changed. Null texts stay null; other columns return as they are, whatever their names."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.struct("*").alias("row"), all_spans(whole, weights).alias("spans"))
    changed = F.size("spans") > 0
    clean = found.select("row", changed.alias("changed"), F.when(changed, redacted(F.col("row")[text], F.col("spans"), mark)).otherwise(F.col("row")[text]).alias("clean"))
    new = {text: F.col("clean"), length: F.when(F.col("changed"), F.length("clean").cast("bigint")).otherwise(F.col("row")[length]) if length in docs.columns else None}
    return clean.select(*(new.get(c, F.col("row")[c]).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))
