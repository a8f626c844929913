"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from the small labelled table below with Spark's own estimator; features are arrays of n-grams made
by DataFrame functions and hashed into BUCKETS. Scoring is one pass over the urls without a shuffle. What the driver holds
is the labelled table and one weight for each bucket.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model from
the marks of its empty ends, which the labelled table has too; ties between rules go to the longest, then to the first by
host and path; repeated rows are judged alike; a very long url is read whole, its n-grams are as many as its characters;
an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: Rules as verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

#: The labelled table, words of hosts to block and of hosts to allow, and words that go with either. A host is a
#: word and one of those, or two words of one label, see :func:`hosts`.
BLOCKED_WORDS = """
casino poker slots jackpot roulette blackjack betting bets wager bingo lottery viagra cialis pills pharmacy steroids xxx porn
sex adult escort nude webcam singles replica payday loans spam seo backlinks ads adserver banner popup clickbait tracker
malware phishing warez keygen
""".split()
ALLOWED_WORDS = """
library museum school university garden kitchen weather history science music theatre orchestra athletics railway harbour
village council heritage journal letters reading evening northern southern gathering understanding brother mother thinking
another hearth rhythm interior internet station addition festival pantry spelling essex adelaide alphabet address window
""".split()
SHARED_WORDS = "best online free my royal club world daily shop 24 live top city house".split()
#: How the hosts' urls are written, with no bearing on their label.
SUBDOMAINS, DOMAINS = ["", "www.", "m.", "blog."], ["example.com", "example.net", "example.org"]
PATHS = ["/en/12", "/fr/907.html", "/en/31?page=2&ref=x", "/en/450", "/de/5/", "/es/88#top", "/en/3", "/fr/65.html", "/de/7", "/en/661/", "/es/901?utm_source=feed", ""]
#: The labelled table, whole urls that their path decides, and what is no url.
BLOCKED_URLS = """
https://example.com/casino/bonus/win https://example.org/ads/click?track=1 https://example.net/xxx/adult/free
https://example.com/cheap/pills/buy https://example.org/sure-bets/today https://example.net/spam/links.html
""".split()
ALLOWED_URLS = """
https://example.com/articles/history-of-tea https://example.org/recipes/bread.html https://example.net/research/papers/12
https://example.com/en/44 https://example.org/de/310?utm_source=feed https://example.net/weather/today
https://example.com/forum/thread/9 about:blank mailto:info index.html unknown
""".split()
#: Urls that a host is listed with.
LISTED = 4


def hosts(words: list[str]) -> list[str]:
    """The hosts of one label: each word before and after a shared one, written together or not, and before another one."""
    out = []
    for k, w in enumerate(words):
        one, two, other = SHARED_WORDS[k % len(SHARED_WORDS)], SHARED_WORDS[(3 * k + 5) % len(SHARED_WORDS)], words[(7 * k + 3) % len(words)]
        out += [f"{one}-{w}", f"{w}{two}", f"{w}-{other}"]
    return out


def labelled(names: list[str], urls: list[str]) -> list[str]:
    """The urls of one label: each host under several subdomains, domains and paths in turn, and the whole urls."""
    forms = lambda k, j: f"https://{SUBDOMAINS[(k + j) % 4]}{{}}.{DOMAINS[(k + 2 * j) % 3]}{PATHS[(5 * k + 7 * j) % 12]}"
    return [forms(k, j).format(h) for k, h in enumerate(names) for j in range(LISTED)] + urls


#: Hash buckets and lengths of n-grams.
BUCKETS, LENGTHS = 1 << 16, (3, 4, 5)
#: Penalty on weights, and probability of block beyond which a url is blocked: what :func:`cross_validated` finds best.
PENALTY, THRESHOLD = 0.0003, 0.5
PENALTIES, THRESHOLDS, FOLDS = (0.0003, 0.001, 0.003), (0.3, 0.4, 0.5, 0.6, 0.7), 4


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), none), F.coalesce(path, none)


def n_grams(host: Column, path: Column) -> Column:
    """The n-grams of host and path, told apart by a letter, with marks at their ends; a run of digits counts as one 0.

    A text is split into its signs once, so the work is linear in its length.
    """

    def of(text: Column, mark: str) -> Column:
        framed = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))

        def grams(signs: Column) -> Column:
            each = lambda n: F.when(F.size(signs) >= n, F.transform(F.sequence(F.lit(1), F.size(signs) - n + 1), lambda i: F.concat(F.lit(mark), F.array_join(F.slice(signs, i, n), "")))).otherwise(F.expr("cast(array() as array<string>)"))
            return F.concat(*[each(n) for n in LENGTHS])

        return F.when(text == "", F.array(F.lit(f"{mark}^$"))).otherwise(F.flatten(F.transform(F.array(F.split(framed, "")), grams)))

    return F.concat(of(host, "h"), of(path, "p"))


def _features(urls: DataFrame) -> DataFrame:
    """``urls`` with host, path and the vector of its hashed n-grams."""
    host, path = host_and_path("url")
    # two steps, so that host and path are worked out once a row
    grams = urls.withColumns({"host": host, "path": path}).withColumn("grams", n_grams(F.col("host"), F.col("path")))
    return HashingTF(binary=True, numFeatures=BUCKETS, inputCol="grams", outputCol="features").transform(grams).drop("grams")


def train(spark: SparkSession, blocked: list[str] | None = None, allowed: list[str] | None = None, penalty: float = PENALTY) -> LogisticRegressionModel:
    """The model of a labelled table of urls, by default the one above; label 1 is block."""
    blocked = labelled(hosts(BLOCKED_WORDS), BLOCKED_URLS) if blocked is None else blocked
    allowed = labelled(hosts(ALLOWED_WORDS), ALLOWED_URLS) if allowed is None else allowed
    rows = [(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed]
    table_ = _features(spark.createDataFrame(rows, "url string, label double").coalesce(1))
    return LogisticRegression(regParam=penalty, maxIter=60, standardization=False).fit(table_)


def cross_validated(spark: SparkSession, penalties: tuple[float, ...] = PENALTIES, thresholds: tuple[float, ...] = THRESHOLDS, folds: int = FOLDS) -> dict[tuple[float, float], tuple[float, float]]:
    """For each penalty and threshold the shares of urls of held-out hosts rightly blocked and rightly allowed.

    A fold holds every ``folds``-th host of each label out, with all its urls; no url of the tables is looked at.
    """
    names = {1: hosts(BLOCKED_WORDS), 0: hosts(ALLOWED_WORDS)}
    whole = {1: BLOCKED_URLS, 0: ALLOWED_URLS}
    right: dict[tuple[float, float], list[int]] = {(p, t): [0, 0] for p in penalties for t in thresholds}
    sizes = [0, 0]
    for fold in range(folds):
        kept = {y: labelled([h for k, h in enumerate(hs) if k % folds != fold], whole[y]) for y, hs in names.items()}
        out = [(u, y) for y, hs in names.items() for u in labelled([h for k, h in enumerate(hs) if k % folds == fold], [])]
        for _, y in out:
            sizes[y] += 1
        held = _features(spark.createDataFrame(out, "url string, held int").coalesce(1))
        for p in penalties:
            scored = train(spark, kept[1], kept[0], p).transform(held).select("held", F.get(vector_to_array("probability"), F.lit(1)).alias("score")).collect()
            for t in thresholds:
                for r in scored:
                    right[p, t][r["held"]] += (r["score"] > t) == bool(r["held"])
    return {k: (blocked / sizes[1], allowed / sizes[0]) for k, (allowed, blocked) in right.items()}


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule whose host or a subdomain of it, and whose path's start, fit; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of block, of each row."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    scored = model.transform(_features(urls)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, by_model).alias("verdict"), "score")


def op1_urls(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; then the model's score."""
    return judge(table(spark, sf_dir, "pages"), train(spark))
