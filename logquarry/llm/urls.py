"""URL filters: host and path rules, and for all other URLs a logistic regression on hashed character n-grams.

DataFrame operations only (the regression is Spark's own). The model is trained from a small labelled URL table
(``LABELLED`` unless the caller brings one); URLs are cut into host and path, each part's character n-grams are
hashed to a fixed number of buckets, so the model's size never depends on the data.

Defined cases: a null URL and one without ``://`` have empty host and path, fit no rule and are judged by the model on
empty features; rows that repeat a ``page_id`` are judged separately; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm.common import written

#: (verdict, host, path prefix); the longest fitting rule wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BUCKETS = 1 << 16
SIZES = (3, 4, 5)  # characters of an n-gram
THRESHOLD = 0.6  # leans towards ordinary, as unknown names mostly are
STEPS = 30

#: The labelled URL table is built from two word lists: what unwanted sites call themselves, and ordinary subjects.
JUNK_WORDS = """
ads adult bets bingo bonus cams casino cash cheap clicks cracked crypto dating debt deals discount escort farm fast fortune free gambling
hacks hot jackpot keygen links loans lottery luck meds money offers payday pharma pills poker popup porn prize profit promo replica rich
roulette sale seo serial sexy slots spam steroids sweepstakes torrents track traffic viagra vip warez watches win xxx
""".split()
ORDINARY_WORDS = """
academy algebra archive architecture art astronomy bakery biology birds books botany bridge brewery camping cathedral chamber chess chemistry
choir church city clinic coast college concert council courses county culture dance dental diary dictionary district drama economics
education engineering family farming festival film fishing folklore forest forum garden geography geology guide harbour health heritage
hiking history hospital island journal kitchen knitting language law learning library linux literature maps marine mathematics medicine
meteorology mountain museum music national nature network news notes observatory opera orchestra painting parish park philosophy physics
poetry post pottery primary programming project puzzle python railway recipes research river robotics rowing sailing school science
sculpture software space sports statistics students swimming tennis theatre times town trail travel trust tutorial university valley
village walking weather wiki wildlife wine woodwork workshop world writers zoology
""".split()
FRONTS = ("", "www.", "", "m.", "blog.", "en.")
PATHS = ("/", "/en/{}", "/index.html", "/de/{}/", "/2024/05/{}", "/about", "/fr/{}.html", "/es/{}", "/page?id={}", "/news/{}", "")


def _site(words: list[str], i: int, junk: bool) -> str:
    """The i-th made-up URL: one word, or two that are joined or hyphenated. A checksum deals the rest evenly."""
    h = crc32(f"{junk} {i}".encode())
    first, second = words[i % len(words)], words[(h >> 16) % len(words)]
    name = (first, f"{first}-{second}", f"{first}{second}")[i // len(words) % 3]
    return f"http{'s' * (h & 1)}://{FRONTS[(h >> 1) % len(FRONTS)]}{name}.test{PATHS[(h >> 5) % len(PATHS)].format(i)}"


#: Three times as many ordinary sites.
BLOCKED = [_site(JUNK_WORDS, i, True) for i in range(4 * len(JUNK_WORDS))]
ALLOWED = [_site(ORDINARY_WORDS, i, False) for i in range(6 * len(ORDINARY_WORDS))]


def labelled(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED], "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty for a null URL or one without ``://``."""
    start = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, letters, letters.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's name and verdict, or null."""
    name = verdict = None
    for kind, suffix, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, suffix + prefix) if name is None else name.when(fits, suffix + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return name, verdict


def _grams(host: Column, path: Column) -> Column:
    """Character n-grams of the host's names but the last, which are marked h, and of the path, marked p."""

    def cut(text: Column, mark: str) -> Column:
        # the characters are bound once, so that a long URL is not walked from its start for every n-gram
        framed = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

        def of(letters: Column, n: int) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(letters) - n, F.lit(0)))
            return F.transform(starts, lambda i: F.concat_ws("", F.lit(mark), *(F.get(letters, i + k) for k in range(n))))

        return F.flatten(F.transform(F.array(framed), lambda letters: F.concat(*(of(letters, n) for n in SIZES))))

    named = F.regexp_replace(host, r"\.[^.]*$", "")
    return F.concat(cut(named, "h"), cut(path, "p"))


def _features(urls: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    cut = urls.withColumns({"_host": host, "_path": path}).withColumn("_grams", _grams(F.col("_host"), F.col("_path")))
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="_grams", outputCol="_vector").transform(cut)


def train(table: DataFrame, *, ridge: float = 0.01) -> LogisticRegressionModel:
    """The model of a small labelled table: url, label (1 unwanted). Null labels are left out.

    Every step of the fit is a job over the table, which is why its features are settled first, in few partitions.
    """
    rows = written(_features(table.filter("label is not null")).select("_vector", "label").coalesce(1), "labelled")
    fit = LogisticRegression(featuresCol="_vector", labelCol="label", regParam=ridge, maxIter=STEPS, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y")
    return fit.fit(rows)


def judge(pages: DataFrame, model: LogisticRegressionModel, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's blocked_score."""
    scored = model.transform(_features(pages.select("page_id", "url")))
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    score = vector_to_array("_p")[1]
    learned = F.when(score >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), name.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), score.alias("blocked_score")
    )


def filter_urls(pages: DataFrame) -> DataFrame:
    return judge(pages, train(labelled(pages.sparkSession)))
