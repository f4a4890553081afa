"""URL filters: rules by host and path first, then logistic regression on hashed character n-grams.

Null urls and urls without "://" have an empty host and path; no rule fits them and the model judges the empty string.
Repeated rows each get their own row; an empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlake.llm.common import lower_ascii, read

#: Fixed by contract: rule (host and path) and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: The labelled URL table: names of unwanted sites, and of ordinary ones, some of which share words with them. Each gives
#: several urls below, so that the model sees them in hosts and in paths, with and without subdomains.
UNWANTED = """grand-casino-bonus casino-royal onlinecasino24 casino-slots bet-today sportsbets betting-tips live-betting bets-and-odds
poker-room free-poker mega-slots slots-jackpot lucky-lottery lottery-results-win win-money big-win cheap-meds pills-online diet-pills pharma-discount
buy-viagra viagra-shop adult-videos adult-chat adult-dating xxx-movies xxx-cams free-porn porn-tube sex-cams sexchat hot-dating escort-service
spam-links bulk-spam spam-mailer link-farm seo-farm cheap-seo seo-backlinks click-farm adserver ads-network banner-ads ads-exchange popup-ads
track-clicks tracking-pixel user-track free-download warez-download warez crack-keygen keygen-serial torrent-movies free-torrents payday-loans
fast-loan cash-loan quick-cash double-your-crypto free-bitcoin free-spins free-prize claim-prize free-iphone get-rich replica-watches cheap-shoes
cheap-replica verify-login phish-account malware-kit hack-tools miracle-cure fake-diploma free-streams cheap-cialis""".split()
ORDINARY = """cityherald national-library university science-museum garden family-recipes travel-diary local-history weather sports-news
classical-music theatre primary-school town-council general-hospital research-journal photo-archive art-gallery cooking physics marine-biology
football-club cycling nature-reserve forest-walks mountain-hut river-trust docs wiki writing-blog reading-group parents teachers letters-page
village-hall bakery castle-tours harbour bird-watching farmers-market farm-shop track-and-field athletics-track adult-education free-library
opensource download-mirror bank insurance railway bus-timetable post-office cinema chess-club choir orchestra poetry novels dictionary
encyclopedia geology astronomy chemistry mathematics statistics engineering architecture carpentry pottery knitting sailing rowing swimming
hiking climbing museum zoo aquarium botanical-garden city-hall parliament court-records police fire-brigade pharmacy-college dentist veterinary
elections newspaper magazine radio television press-review interview-archive cheese-makers wine-growers beekeeping gardening-calendar""".split()
#: Words that name such sites, each put beside two of the words that often stand with them.
STEMS = "casino poker bets betting slots jackpot lottery pills meds viagra adult xxx porn sex dating escorts spam seo click ads adserver tracker popup warez crack torrent loans cash crypto prize replica phishing malware".split()
COMPANIONS = "online free best royal cheap now club 24 world super my top".split()
#: Sites whose names say nothing are ordinary: names made up of syllables, and as many of letters, frequent ones more often.
MADE_UP, LETTERS = 250, "eeeeeetttttaaaaooooiiiinnnnssshhhrrrdddllluuccmmffwwyyggppbbvk"
ENDS = ("example.com", "example.org", "example.net", "test")
PATHS = ("/en/12", "/de/345.html", "/fr/6789", "/es/100/", "/", "/en/4711", "/index.html")
#: Buckets for hashed n-grams; how often an unwanted url counts.
FEATURES, UNWANTED_WEIGHT = 1 << 15, 2.5


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains, if the path starts with its path."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # the longest is tried first
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        found = F.when(fits, rule).otherwise(found)
    return found


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4, 5)) -> Column:
    """Character n-grams of ^host$ and ^path$, marked by where they stand."""
    def slices(mark: str, text: Column, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    framed = {"h": F.concat(F.lit("^"), host, F.lit("$")), "p": F.concat(F.lit("^"), F.lower(path), F.lit("$"))}
    parts = [slices(mark, text, n) for mark, text in framed.items() for n in sizes]
    return F.concat(*parts)


def made_up(count: int = MADE_UP) -> list[str]:
    """Names of two to four syllables, and of four to ten letters."""
    rng = random.Random(5)
    onsets, vowels, ends = "b c d f g h l m n p r s t v w z br ch cl dr gr pl sh st th tr".split(), "a e i o u ea ou".split(), "n r s t nd st l".split()

    def syllable() -> str:
        return rng.choice(onsets) + rng.choice(vowels) + rng.choice([*ends, "", "", ""])

    spoken = ["".join(syllable() for _ in range(rng.randrange(2, 5))) for _ in range(count)]
    return spoken + ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(4, 11))) for _ in range(count)]


def urls_of(names: list[str]) -> list[str]:
    """Several urls of each named site."""
    return [f"https://{sub}{name}.{ENDS[(k + j) % 4]}{PATHS[(k + 2 * j) % 7]}" for k, name in enumerate(names) for j, sub in enumerate(("", "www.", "m.", "blog."))]


def labelled_urls(spark: SparkSession, unwanted: list[str] = UNWANTED, ordinary: list[str] = ORDINARY) -> DataFrame:
    """(url, label): the small table that the model is trained on; label 1.0 is unwanted."""
    nothing = made_up()
    unwanted = [*unwanted, *(f"{stem}-{COMPANIONS[k % 12]}" for k, stem in enumerate(STEMS)), *(f"{COMPANIONS[k % 12]}{stem}" for k, stem in enumerate(STEMS, 5))]
    rows = [(u, 1.0) for u in urls_of(unwanted)] + [(u, 0.0) for u in urls_of(ordinary + nothing)]
    for label, names in ((1.0, unwanted), (0.0, ordinary)):
        rows += [(f"http://{(ordinary + nothing)[k]}.{ENDS[k % 4]}/{name}/{k}", label) for k, name in enumerate(names)]
    urls, labels = ([row[k] for row in rows] for k in (0, 1))
    listed = spark.range(1).select(F.posexplode(F.lit(urls)).alias("k", "url"))
    return listed.select("url", F.get(F.lit(labels), F.col("k")).alias("label"))


def train(labelled: DataFrame, reg: float = 1e-3) -> PipelineModel:
    """Logistic regression from (url, label). Unwanted urls, which are fewer, count UNWANTED_WEIGHT times."""
    data = labelled.select(grams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"), "label", F.when(F.col("label") == 1.0, UNWANTED_WEIGHT).otherwise(1.0).alias("weight"))
    hashed = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    fit = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=reg, maxIter=60)
    return Pipeline(stages=[hashed, fit]).fit(data.coalesce(1))


def judge_urls(pages: DataFrame, model: PipelineModel, rules: dict[str, str], *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, score, verdict) of each row: the fitting rule's verdict, else the model's."""
    parsed = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = parsed.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), list(rules)))
    scored = model.transform(ruled.withColumn("grams", grams(F.col("host"), F.col("path"))))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    by_model = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select(id_col, "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    return judge_urls(read(spark, sf_dir, "pages"), train(labelled_urls(spark)), RULES)
