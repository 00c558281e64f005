"""URL filters: rules by host and path, and logistic regression on character n-grams.

Only DataFrame functions: n-grams of host and path are hashed to buckets, a
small labelled table gives one weight per bucket, and a URL's score is a sum of
weights inside one expression.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = (4, 5)
BUCKETS = 1 << 14

# Rules of the default filter: host and path beginning, and what they say.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The default labelled table, by rule: plain words, alone and in pairs, as hosts and in paths.
UNWANTED = (
    "casino poker jackpot roulette slots gambling betting bets wager lottery pills viagra meds steroids replica spam "
    "phishing malware adult porn xxx escort cams loans payday adserver adclick popup banner tracker tracking ads "
    "cheap bonus free"
).split()
WANTED = (
    "news weather library museum garden kitchen history science physics medicine school teacher university journal "
    "review travel mountain river forest ocean music theatre cinema football swimming bicycle railway airport harbour "
    "market bakery summer winter morning evening house street village council parliament court hospital city paper "
    "book story letter answer question number person country water earth light world family friend mother father "
    "brother sister children people nation station motion reason lesson season winter north south eastern western "
    "another thirteen breath feather leather together either weather entire interest center teaching reading nothing "
    "evening standing hand land band order under thunder wonder water master faster sister action section "
    "table noble double capable early only family daily health wealth earth tooth where while white what which often "
    "soften listen ship short shine idea area great least heat neat head ready already instead present recent"
).split()
KINDS = ("{}.example.com", "www.{}.example.org", "blog.{}.example.net", "m.{}.example.com")
PATHS = ("/", "/en/1234", "/de/77.html", "/fr/501/", "/es/9")
# Hosts that say nothing, for what paths alone tell.
NEUTRAL = ("example.com", "www.example.org")


def names_of(words: Sequence[str]) -> list[str]:
    """The words, each also joined with three others by a hyphen and with one without."""
    n = len(words)
    pairs = [f"{w}-{words[(i + k) % n]}" for i, w in enumerate(words) for k in (1, 5, 11)]
    return list(dict.fromkeys([*words, *pairs, *(w + words[(i + 7) % n] for i, w in enumerate(words))]))


def labelled(spark: SparkSession, unwanted: Sequence[str] = UNWANTED, wanted: Sequence[str] = WANTED) -> DataFrame:
    """The default labelled URLs: ``url`` and ``unwanted`` (0 or 1).

    Each name comes with every kind of host and common path, and as a path of
    hosts that say nothing, so only names tell the labels apart. The words are
    everyday ones of their kinds of sites; no whole name of a table is among them.
    """
    names = [(x, 1) for x in names_of(unwanted)] + [(x, 0) for x in names_of(wanted)]
    rows = [(f"https://{kind.format(name)}{path}", label) for name, label in names for kind in KINDS for path in PATHS]
    rows += [(f"https://{host}/{name}{end}", label) for name, label in names for host in NEUTRAL for end in ("", "/1234", "/index.html")]
    return spark.createDataFrame(rows, "url string, unwanted int")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _slices(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))


def ngrams(text: Column, mark: str, between: str) -> Column:
    """Buckets of the character n-grams of each part of a text; a number reads as one 0."""
    text = F.replace(F.regexp_replace(text, "[0-9]+", "0"), F.lit(between), F.lit("$^"))
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    grams = F.concat(*[_slices(marked, n) for n in SIZES])
    inside = F.filter(grams, lambda g: ~g.contains("$^"))
    return F.transform(inside, lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(BUCKETS)).cast("int"))


def grams_of(url: Column) -> Column:
    return F.concat(ngrams(host_of(url), "host", "."), ngrams(path_of(url), "path", "/"))


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: tuple[float, ...]

    def probability(self, grams: Column) -> Column:
        """Chance that a URL with these n-grams is unwanted."""
        table = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")  # folded to a constant
        total = F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(table, g))
        return 1 / (1 + F.exp(-(total + self.intercept)))


def fit(rows: DataFrame, url: str = "url", label: str = "unwanted", penalty: float = 0.0005) -> Model:
    """Train on a small labelled table; rows with a NULL label are left out.

    The table must have both labels. The model has one weight per bucket, so
    its size does not depend on the table.
    """
    named = rows.where(F.col(label).isNotNull())
    grams = named.select(grams_of(F.col(url)).cast("array<string>").alias("grams"), F.col(label).cast("double").alias("label"))
    counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "grams", "counts")
    fitted = LogisticRegression(featuresCol="counts", regParam=penalty, maxIter=200, standardization=False)
    fitted = fitted.fit(counter.transform(grams))
    return Model(float(fitted.intercept), tuple(float(w) for w in fitted.coefficients.toArray()))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, NULL where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits is the longest
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(F.lit("." + name))) & path.startswith(F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(df: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", least: float = 0.5) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``probability`` and ``verdict`` to each row.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest decides, else the model: ``block`` from probability ``least``
    on. A NULL or empty URL, or one without ``://``, has an empty host and
    path, which the model judges like any other. Rows and other columns stay;
    those named like a new column are replaced.
    """
    rows = df.drop("host", "path", "rule", "probability", "verdict") if url not in ("host", "path") else df
    out = rows.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "probability": model.probability(grams_of(F.col(url)))})
    by_model = F.when(F.col("probability") >= least, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce(says, by_model))
