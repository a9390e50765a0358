"""Secret scans: rule matches, plus tokens that a Markov model of random strings explains better than one of identifiers.

All of it is DataFrame operations. Three fixed rules give the base spans. Their values are the labelled samples of
random strings; the tokens that no rule touches, of every distinct text, are the samples of ordinary identifiers,
words and paths. Both train a first-order character Markov model over 65 symbol classes, upper and
lower case apart, and every other token of 12 or more characters with a letter among them is scored by the mean
log-likelihood ratio of its transitions. It is added where the ratio is above `ratio` and a limit set by both kinds of
samples. Numbers and dates, which have no letter, are left to the rules.

Null and empty texts have no spans. A text that repeats keeps spans per row. Extra columns stay, but for one named `spans`,
which is replaced; names that begin with _secret_ are the operator's own.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, table

#: Fixed rules.
ASSIGN = r"""(?=[AaPpSsTt])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models may add.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{12,}+"
#: Tokens that teach the ordinary model.
TOKEN = r"[A-Za-z0-9+/_=-]{4,}+"
#: The limit lies halfway between these quantiles of the ordinary samples that are candidates, and of the random ones.
BULK, LOW = 0.95, 0.01
#: A transition counts no more than this, so that a few which samples lack do not decide.
MOST_RATIO = 4.0
#: Classes of characters for the models; = and - have one each, all others one.
SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = len(SYMBOLS) + 3


def _placed(found: Column, gaps: Column, kind: str) -> Column:
    """Matches with the text between them, as spans."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(found, i))
        span = F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.get(found, i).alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    each = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda a: a["out"])
    return F.when(F.size(found) > 0, each).otherwise(none)


def _match(docs: DataFrame, rules: dict[str, str]) -> DataFrame:
    """docs with the leftmost matches that do not overlap of each rule, as arrays of struct<kind, start, end, value>
    in code points, in columns named after the kinds with `_secret_` before them.

    The text between matches comes from split with the same pattern, so the place of a match is the sum of the lengths
    before it. Matches and gaps are columns of their own, so that each is computed once a row, and gaps only where a
    rule has matched.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumns({f"_secret_m_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in rules.items()})
    docs = docs.withColumns({f"_secret_g_{k}": F.when(F.size(f"_secret_m_{k}") > 0, F.split(text, p, -1)) for k, p in rules.items()})
    docs = docs.withColumns({f"_secret_{k}": _placed(F.col(f"_secret_m_{k}"), F.col(f"_secret_g_{k}"), k) for k in rules})
    return docs.drop(*[f"_secret_{x}_{k}" for k in rules for x in "mg"])


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `_secret_base`: the spans of the three fixed rules, one kind after the other."""
    docs = _match(docs, {"assign": ASSIGN, "access": ACCESS, "hex": HEX})
    assign = F.filter("_secret_assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= ASSIGN_MIN)
    return docs.withColumn("_secret_base", F.concat(assign, "_secret_access", "_secret_hex")).drop("_secret_assign", "_secret_access", "_secret_hex")


def _class(c: str) -> int:
    """Class of a character: its place in SYMBOLS, then = - and the rest."""
    at = SYMBOLS.find(c)
    return at if at >= 0 else {"=": CLASSES - 3, "-": CLASSES - 2}.get(c, CLASSES - 1)


def _symbol(c: Column) -> Column:
    """_class as an expression."""
    at = F.instr(F.lit(SYMBOLS), c)
    return F.when(at > 0, at - 1).when(c == "=", CLASSES - 3).when(c == "-", CLASSES - 2).otherwise(CLASSES - 1)


def _moves(value: Column) -> Column:
    """Transitions of a string as from-class * CLASSES + to-class."""
    n = F.length(value)
    return F.transform(F.sequence(F.lit(1), n - 1), lambda i: _symbol(F.substring(value, i, F.lit(1))) * CLASSES + _symbol(F.substring(value, i + 1, F.lit(1))))


def _mean_ratio(value: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of a string."""
    weights = F.from_json(F.lit(str(ratios)), "array<double>")  # a constant, folded once
    return F.aggregate(_moves(value), F.lit(0.0), lambda a, m: a + F.get(weights, m)) / (F.length(value) - 1)


def train_models(docs: DataFrame) -> tuple[list[float], float]:
    """Log-likelihood ratio (random over ordinary) of each of the CLASSES x CLASSES transitions, and a limit of the mean ratio
    between most ordinary samples and nearly all random ones.

    Labelled samples come from every distinct text: values that a rule matches are random strings, other tokens are ordinary,
    but for long ones that occur once. What comes to the driver is one count for each transition and
    model, and two numbers. Random strings have a uniform prior, so the model works without a single labelled secret.
    """
    sampled = base_spans(docs.select("text").where("text IS NOT NULL").distinct())
    value = F.when(F.col("s.kind") == "assign", F.regexp_extract("s.value", ASSIGN, 1)).otherwise(F.col("s.value"))
    secrets = sampled.select(F.explode("_secret_base").alias("s")).select(value.alias("value"), F.lit(1).alias("random"))
    rest = F.regexp_replace("text", "|".join((ASSIGN, ACCESS, HEX)), " ")
    words = sampled.select(F.explode(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0))).alias("value"), F.lit(0).alias("random"))
    once = (F.col("random") == 0) & (F.col("count") == 1) & (F.length("value") >= 12)  # may be a secret without a label
    samples = saved(secrets.unionByName(words).groupBy("random", "value").count().where(~once))
    pairs = samples.select("random", "count", "value", F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("i")).select("random", "count", F.expr("substring(value, i, 2)").alias("pair"))
    got: Counter = Counter()
    for r in pairs.groupBy("random", "pair").agg(F.sum("count").alias("n")).collect():  # ASCII pairs: at most 2 x 66 x 66 rows
        got[r["random"], _class(r["pair"][0]) * CLASSES + _class(r["pair"][1])] += r["n"]
    ends = [1 + sum(got[0, a * CLASSES + b] for a in range(CLASSES)) for b in range(CLASSES)]
    # what a row of the table has not seen: any character is as likely in random strings, and as in general in ordinary ones
    prior, out = {0: [4 * (0.9 * x / sum(ends) + 0.1 / CLASSES) for x in ends], 1: [2.0] * CLASSES}, []
    for a in range(CLASSES):
        own = {k: [got[k, a * CLASSES + b] + prior[k][b] for b in range(CLASSES)] for k in prior}
        ratios = [math.log(own[1][b] / sum(own[1])) - math.log(own[0][b] / sum(own[0])) for b in range(CLASSES)]
        out += [round(min(MOST_RATIO, max(-MOST_RATIO, x)), 4) for x in ratios]
    ratio = _mean_ratio(F.col("value"), out)
    high = F.percentile_approx(F.when((F.col("random") == 0) & F.col("value").rlike(CANDIDATE), ratio), BULK, 100_000)
    low = F.percentile_approx(F.when((F.col("random") == 1) & (F.length("value") >= 12), ratio), LOW, 100_000)
    high, low = samples.agg(high, low).first()
    return out, -1e9 if high is None else high if low is None else max(high, (high + low) / 2)


def scan_secrets(docs: DataFrame, ratio: float = 1.0, model: tuple[list[float], float] | None = None) -> DataFrame:
    """docs with `spans`: array<struct<kind, start, end, value>> by start, then kind as listed in KINDS.

    A token outside every rule match, of 12 characters or more, is added as `markov` when its mean log-likelihood ratio
    per transition is at least `ratio` and above the model's limit for ordinary samples.
    """
    ratios, ordinary = train_models(docs) if model is None else model
    docs = _match(base_spans(docs.drop("spans")), {"markov": CANDIDATE})
    overlap = lambda s: F.exists("_secret_base", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]))
    mean = lambda s: _mean_ratio(s["value"], ratios)
    added = F.filter("_secret_markov", lambda s: (mean(s) >= ratio) & (mean(s) > ordinary) & ~overlap(s))
    rank = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(4), strict=True) for x in pair])
    keyed = F.transform(F.concat("_secret_base", added), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    spans = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return docs.withColumn("spans", spans).drop("_secret_base", "_secret_markov")


def redact(found: DataFrame, mask: str = "[secret]") -> DataFrame:
    """What scan_secrets returned with each span of `text` replaced by mask, spans that overlap by one, and without
    `spans`. Null text stays null."""
    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    new = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, rest)
    return found.withColumn("text", F.when(F.size("spans") > 0, new).otherwise(F.col("text"))).drop("spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    """op4: span counts and digests per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
