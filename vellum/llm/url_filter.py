"""URL filter: rules by host and path, then gradient-boosted trees on lexical features.

Features of a url: length, host length, path depth, digit ratio, character
entropy, hyphens, dots, query parameters; block rates of its last host label, of its
host's first label, and of the character 4-grams of its host and path words, hashed into
:data:`GRAMS` slots (of the host the largest, the largest mean of three in a row, and the mean of all). A rate
counts each training host once, both labels with the same weight in all, and is
smoothed towards a half by :data:`PRIOR` hosts, so a value seen on few hosts says little and none
drops out. A training url's rates come from hosts of the other folds. The trees
are Spark's own, fitted on at most :data:`SAMPLE` labelled urls, taken in the order of a
hash, and on contrast urls (:func:`contrasts`): each host with its hyphens taken out or one put in,
and under the other suffixes, so that neither marks nor suffixes stand for the words. Every url is judged.

Where no labels are given, they come from :func:`lexical_labels`: a host with a
word of :data:`LEXICON` is one to block. Its words, alone and joined with each other and with
words of the hosts, are contrast urls too, as are harmless words that contain them (:data:`HARMLESS`). The rules' own
verdicts are no labels, as they follow hosts and languages and not what a url looks like.

Defined results: a null url, or one without ``://``, has empty host and path, fits
no rule and is judged by the method on the features of the empty string; repeated
rows each get their row; without labelled urls of both kinds the method allows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from vellum.llm.rows import small_batches

#: Labelled urls fitted at most; hosts that get contrasts; trees; their depth; hosts that smooth a rate; folds of the rates; slots of 4-grams.
SAMPLE, CONTRASTED, TREES, DEPTH, PRIOR, FOLDS, GRAMS = 20_000, 1_000, 20, 4, 2.0, 5, 1 << 17
#: Words between the marks of a host that label it as one to block: gambling, adult, medicine, loans, spam, tracking.
LEXICON = ("ads", "adult", "bet", "bets", "betting", "casino", "gambling", "loans", "lottery", "payday", "pharma", "pills", "poker", "porn", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx")
#: Harmless words: some that contain one of the list, some that stand beside listed ones on hosts to block, and common ones.
HARMLESS = (
    "downloads", "uploads", "roads", "heads", "threads", "beads", "leads", "alphabet", "better", "tibet", "between", "soundtrack", "racetrack", "adulthood", "pharaoh", "timeslots", "trackfield", "abetting", "software", "sitting", "joker", "slow",
    "free", "cheap", "win", "farm", "now", "online", "best", "top", "big", "super", "easy", "quick", "real", "live", "play", "game", "games", "money", "cash", "credit", "bank", "health", "doctor", "drug", "store", "buy",
    "air", "animal", "answer", "art", "baby", "ball", "bird", "blue", "body", "bread", "bridge", "brother", "build", "business", "camera", "car", "center", "chair", "child", "church", "city", "class", "clean", "clear", "close", "cloud",
    "coffee", "color", "common", "computer", "cook", "corner", "country", "course", "dance", "daughter", "design", "dinner", "dog", "door", "dream", "drive", "earth", "education", "energy", "engine", "family", "father", "field", "film", "fire", "fish",
    "floor", "flower", "food", "forest", "friend", "gallery", "glass", "gold", "government", "grass", "green", "group", "hand", "heart", "history", "home", "horse", "hospital", "hotel", "house", "island", "journal", "kitchen", "lake", "language", "law",
    "letter", "light", "machine", "magazine", "market", "mother", "mountain", "museum", "music", "nature", "night", "ocean", "office", "open", "people", "photo", "plant", "police", "president", "project", "radio", "research", "restaurant", "river", "school",
    "science", "service", "shoe", "sister", "sky", "society", "sport", "spring", "star", "street", "student", "summer", "teacher", "travel", "tree", "university", "village", "water", "weather", "winter", "woman", "world", "writer", "young",
)
#: The rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
FEATURES = ("f_length", "f_host", "f_depth", "f_digits", "f_entropy", "f_hyphens", "f_dots", "f_params", "f_query", "f_suffix", "f_prefix", "f_gram", "f_gram_run", "f_gram_mean", "f_path_gram")


def _lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add _url (never null), host and path."""
    df = df.withColumn("_url", F.coalesce(F.col(url_col), F.lit("")))
    rest = F.when(F.instr("_url", "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    df = df.withColumn("_rest", rest)
    df = df.withColumn("host", _lower(F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)))
    return df.withColumn("path", F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)).drop("_rest")


def rule_columns(rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; nulls where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}")) for _, h, _ in ordered]
    fits = [f & F.startswith(F.col("path"), F.lit(p)) for f, (_, _, p) in zip(fits, ordered)]
    pick = lambda what: F.coalesce(*[F.when(f, F.lit(what(r))) for f, r in zip(fits, ordered)])
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def with_features(df: DataFrame) -> DataFrame:
    """Add the features that need no training, and the labels _suffix and _prefix of the host."""
    url, n = F.col("_url"), F.greatest(F.length("_url"), F.lit(1))
    share = lambda c: (F.length("_url") - F.length(F.replace(url, c))) / n
    chars = F.filter(F.array_distinct(F.split("_url", "")), lambda c: c != "")
    entropy = F.aggregate(chars, F.lit(0.0), lambda sum_, c: sum_ - share(c) * F.log2(share(c)))
    query = F.regexp_extract("_url", r"(?s)\?([^#]*)", 1)
    return df.withColumns({
        "f_length": F.length("_url").cast("double"),
        "f_host": F.length("host").cast("double"),
        "f_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
        "f_digits": F.length(F.regexp_replace("_url", "[^0-9]", "")) / n,
        "f_entropy": entropy,
        "f_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "f_dots": F.regexp_count("host", F.lit(r"\.")).cast("double"),
        "f_params": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
        "f_query": F.length(query).cast("double"),
        "_suffix": F.substring_index("host", ".", -1),
        "_prefix": F.substring_index("host", ".", 1),
    })


def gram_slots(text: str) -> list[list[int]]:
    """Slots of the 4-grams of each of a text's words, in order; a word has a mark at both ends."""
    marked = (f"^{w}$" for w in regex.findall(r"\p{L}+", text))
    return [[xxhash.xxh64_intdigest(w[k : k + 4]) % GRAMS for k in range(max(1, len(w) - 3))] for w in marked]


class Rates:
    """Block rates of one kind of value by its hosts, each host once, both labels with the same weight; 0.5 for values without hosts."""

    def __init__(self, values: list[set], labels: list[float]) -> None:
        share = [max(1, sum(y == k for y in labels)) for k in (0, 1)]
        bad, all_ = Counter(), Counter()
        for vs, y in zip(values, labels):
            weight = len(labels) / (2 * share[int(y)])
            for v in vs:
                bad[v] += weight * y
                all_[v] += weight
        self.rate = {v: (bad[v] + PRIOR / 2) / (all_[v] + PRIOR) for v in all_}

    def get(self, value: object) -> float:
        return self.rate.get(value, 0.5)

    def figures(self, words: list[list[int]]) -> tuple[float, float, float]:
        """The largest rate of a 4-gram, the largest mean over three that follow each other in a word, the mean of all."""
        rates = [[self.get(k) for k in w] for w in words]
        if not rates:
            return 0.5, 0.5, 0.5
        every = [r for w in rates for r in w]
        runs = [sum(w[k : k + 3]) / len(w[k : k + 3]) for w in rates for k in range(max(1, len(w) - 2))]
        return max(every), max(runs), sum(every) / len(every)


class RateModel:
    """The rates of suffixes, first labels and 4-grams; bounded by the urls fitted on."""

    def __init__(self, hosts: list[tuple[str, str, float]]) -> None:
        """``hosts``: (host, path, label), each host once."""
        y = [h[2] for h in hosts]
        self.suffix = Rates([{h.rpartition(".")[2]} for h, _, _ in hosts], y)
        self.prefix = Rates([{h.partition(".")[0]} for h, _, _ in hosts], y)
        self.grams = Rates([{k for w in gram_slots(h.rpartition(".")[0]) for k in w} for h, _, _ in hosts], y)
        self.paths = Rates([{k for w in gram_slots(p) for k in w} for _, p, _ in hosts], y)

    def features(self, host: str, path: str) -> tuple[float, ...]:
        return (self.suffix.get(host.rpartition(".")[2]), self.prefix.get(host.partition(".")[0]), *self.grams.figures(gram_slots(host.rpartition(".")[0])), self.paths.figures(gram_slots(path))[1])


RATED = ("f_suffix", "f_prefix", "f_gram", "f_gram_run", "f_gram_mean", "f_path_gram")


class UrlModel:
    """Fitted trees and the block rates that their features take."""

    def __init__(self, trees: object, rates: RateModel) -> None:
        self.trees, self.rates = trees, rates

    def encode(self, df: DataFrame) -> DataFrame:
        """Add all features to rows of :func:`with_parts`; urls that share host and path are worked out once a batch."""
        held = df.sparkSession.sparkContext.broadcast(self.rates)  # bounded by the sample

        @F.pandas_udf(", ".join(f"{c} double" for c in RATED))
        def rated(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for hosts, paths in batches:
                known: dict[tuple[str, str], tuple[float, ...]] = {}
                rows = []
                for key in zip(hosts, paths):
                    if key not in known:
                        known[key] = held.value.features(*key)
                    rows.append(known[key])
                yield pd.DataFrame(rows, columns=list(RATED), dtype=float)

        small_batches(df.sparkSession)
        return with_features(df).withColumn("_rated", rated("host", "path")).select("*", "_rated.*").drop("_rated")

    def verdicts(self, df: DataFrame) -> DataFrame:
        """Add _method: block where the trees' probability is over a half."""
        if self.trees is None:
            return df.withColumn("_method", F.lit("allow"))
        out = self.trees.transform(_vectors().transform(self.encode(df)))  # adds rawPrediction and probability too
        return out.withColumn("_method", F.when(F.col("_predicted") > 0.5, "block").otherwise("allow"))

    def importances(self) -> dict[str, float]:
        """What each feature's splits gain, of 1 in all."""
        return {} if self.trees is None else dict(zip(FEATURES, self.trees.featureImportances.toArray().round(4).tolist()))


def _vectors() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features", handleInvalid="keep")


def contrasts(rows: list[tuple[str, str, float]], most: int = CONTRASTED) -> list[tuple[str, float]]:
    """Urls with the words of the (host, path, label) given and other marks and suffixes, under the same label."""
    out, suffixes = [], sorted({h.rpartition(".")[2] for h, _, _ in rows if "." in h})
    for k, (host, path, y) in enumerate(rows[:most]):
        name, dot, suffix = host.rpartition(".")
        first, _, rest = name.partition(".")
        if len(first) < 4 and rest:  # www, m: the next label has the words
            first, rest = rest.partition(".")[0], rest.partition(".")[2]
        other = first.replace("-", "") if "-" in first else f"{first[: len(first) // 2]}-{first[len(first) // 2 :]}" if len(first) > 7 else f"{first}-{first}"
        for n, label in enumerate((first, other)):
            for s in ([suffixes[(k + n) % len(suffixes)], suffix] if suffixes else [suffix]):
                out.append((f"http://{label}{'.' + rest if rest else ''}{dot}{s}{path}", y))
    return out


def lexical_contrasts(rows: list[tuple[str, str, float]], most: int = CONTRASTED) -> list[tuple[str, float]]:
    """Urls with the words of LEXICON (label 1) and of HARMLESS (label 0), alone, joined, and with a hyphen between them and words of the hosts."""
    suffixes = sorted({h.rpartition(".")[2] for h, _, _ in rows if "." in h}) or ["com"]
    plain = sorted({w for h, _, y in rows if y < 0.5 for w in regex.findall(r"[a-z]{4,}", h)} - set(suffixes)) or ["example", "garden"]
    names, n = [], len(LEXICON)
    for k, word in enumerate(LEXICON):
        near = (*HARMLESS[22:], *plain)[(7 * k) % (len(HARMLESS) - 22 + len(plain))]
        names += [(x, 1.0) for x in (word, f"{word}{LEXICON[(k + 5) % n]}", f"{LEXICON[(k + 3) % n]}{word}", f"{word}{near}", f"{word}-{near}", f"{near}-{word}", f"my{word}")]
    for k, word in enumerate((*HARMLESS, *plain[:most])):
        near = (*HARMLESS, *plain)[(5 * k + 1) % (len(HARMLESS) + len(plain))]
        names += [(x, 0.0) for x in (word, f"{word}-{near}", f"my-{word}", f"{near}{word}")]
    paths = [p for _, p, _ in rows] or ["/"]
    return [(f"http://{name}.{suffixes[k % len(suffixes)]}{paths[k % len(paths)]}", y) for k, (name, y) in enumerate(names)]


def fit(labelled: DataFrame, sample: int = SAMPLE, lexical: bool = False) -> UrlModel:
    """Fit on (url, label): label 1 is block. Null labels are left out; ``lexical`` adds the contrasts of the word lists."""
    spark = labelled.sparkSession
    rows = with_parts(labelled.where("label IS NOT NULL").select("url", F.col("label").cast("double").alias("label")))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(sample).collect()  # at most ``sample`` short strings
    first = {r.host: (r.host, r.path, r.label) for r in reversed(rows)}
    hosts = [first[h] for h in dict.fromkeys(r.host for r in rows)]
    more = contrasts(hosts) + (lexical_contrasts(hosts) if lexical else [])
    every = [(r.url or "", r.label) for r in rows] + more
    if len({y for _, y in every}) < 2:
        return UrlModel(None, RateModel([]))
    overall = sum(y for _, y in every) / len(every)
    local = spark.createDataFrame(every, "url string, label double").coalesce(1)
    parts = with_parts(local).withColumn("fold", F.pmod(F.xxhash64(F.regexp_replace("host", "[^a-z]", "")), F.lit(FOLDS)).cast("int"))
    held = {r.host: (r.host, r.path, r.label, r.fold) for r in parts.select("host", "path", "label", "fold").collect()}  # the same bound
    model = UrlModel(None, RateModel([h[:3] for h in held.values()]))
    frames = [UrlModel(None, RateModel([h[:3] for h in held.values() if h[3] != k])).encode(parts.where(F.col("fold") == k)) for k in range(FOLDS)]
    encoded = frames[0]
    for f in frames[1:]:
        encoded = encoded.union(f)
    weight = F.when(F.col("label") > 0.5, 0.5 / overall).otherwise(0.5 / (1 - overall))
    gbt = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", predictionCol="_predicted", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, checkpointInterval=-1)
    figures = encoded.select(*FEATURES, "label", weight.alias("weight")).collect()  # the same bound; else each tree would work them out anew
    figures = spark.createDataFrame(sorted(map(tuple, figures)), ", ".join(f"{c} double" for c in (*FEATURES, "label", "weight")))
    model.trees = gbt.fit(_vectors().transform(figures.coalesce(1)).select("_features", "label", "weight"))
    return model


def lexical_labels(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, label), each url once: 1 where a word of the host, between its marks, is in LEXICON; urls without a host have none."""
    parts = with_parts(pages.select(F.col(url_col).alias("url"))).where("host <> ''")
    listed = F.arrays_overlap(F.split("host", "[^a-z]+"), F.array(*map(F.lit, LEXICON)))
    return parts.select("url", listed.cast("double").alias("label")).distinct()


def judge(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, a row for each row of ``pages``."""
    rule, verdict = rule_columns(rules)
    parts = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    out = model.verdicts(parts.withColumn("rule", rule).withColumn("_ruled", verdict))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_ruled", "_method").alias("verdict"))


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url; without ``labelled`` (url, label) labels come from the lexicon."""
    model = fit(lexical_labels(pages, url_col), lexical=True) if labelled is None else fit(labelled)
    return judge(pages, model, id_col, url_col)
