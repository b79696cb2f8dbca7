"""Operator 9: secret scan with a random forest that takes false positives away; DataFrame functions only.

A pattern finds candidates: runs of 12 and more characters of keys and tokens; whatever a name for a secret is assigned,
of any length, up to its quote or white space (a run inside is part of it); headers of PEM blocks. Between the name, the
sign and the value there may be 32 white-space characters each. Rejecting harmless candidates, such as long words, is
left to the forest. Each is described by its length, the share of digits, capitals and small letters, its distinct
characters, its character transitions (the changes of character class from one character to the next, and the mean log
probability of its pairs of letters, by a model of the letters that follow each other in the words of all documents),
the share that dictionary words cover, its place in a path, address or link, and the words beside it (names of secrets,
an assignment or quotes before it). A random forest, trained on labelled findings, scores it.

Labelled findings are the candidates of all documents by the `labels` column if the caller has one for findings (those
it gives null aren't labelled), else by KNOWN and NAMES (key formats of known issuers, values of any length assigned to a
name for a secret but placeholders, and short values of letters alone, which aren't labelled), with all other candidates as false. The forest trains on at most about `sample_findings` of each kind, chosen by
a hash and weighted by the inverse of their kind's share, so that kinds count as often as they occur however large the
table is, and a rare kind is there in full. The forest sees none of the rules, only the description. The dictionary is
the `dictionary_words` most frequent words of three and more letters of all documents. The forest's size doesn't grow
with the corpus.

Defined results: null and empty texts have no findings. Repeated rows have findings each. Candidates of one document
are numbered in order. Where the labelled findings are of one kind only, or there are none, the rules decide and the
score is 0 or 1. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Fixed: names for secrets.
NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
#: The sign of equality after a name isn't padding of the run.
RUN = rf"(?<![A-Za-z0-9_+/~@.-])[A-Za-z0-9_+/~@.-]{{12,}}(?:(?<!{NAMED})={{1,2}})?"
PEM = "-----BEGIN [A-Z0-9 ]+-----"
_SIGN = NAMED + r"[\"']?\s{0,32}(?:=>|=|:)\s{0,32}"
#: A value after its name; the first two conditions only spare most places the third.
VALUE = rf"(?<=[=:>\s\"'])(?<=[=:>]\s{{0,32}}[\"']?)(?!(?<==)>)(?:(?<={_SIGN}\")[^\s\"]+|(?<={_SIGN}')[^\s']+|(?<={_SIGN})[^\s\"']+)"
CANDIDATE = f"{PEM}|{VALUE}|{RUN}"
#: Fixed: formats of keys of known issuers, and headers of private keys.
KNOWN = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[0-9A-Za-z_-]{30,}$|^sk_(?:live|test)_[0-9A-Za-z]{16,}$|^glpat-[0-9A-Za-z_-]{20}$|^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|^-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----$"
NAMES = NAMED + r"[\"']?\s*(?:=|:|=>)\s*[\"']?$"
NAME = r"(?i)(?:password|passwd|pwd|secret|token|key|credential|auth|login)"
FEATURES = ["length", "digits", "upper", "lower", "other", "distinct", "changes", "pairs", "hexadecimal", "covered", "slashes", "dots", "at", "in_link", "named", "assigned", "quoted", "ends"]


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("candidate", pattern, "")) / F.length("candidate")


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each candidate with the text beside it."""
    base = docs.select(*keep, "text").filter(F.col("text").rlike(CANDIDATE))
    cut_up = base.select(*keep, F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("found"), F.split("text", CANDIDATE).alias("between"))
    each = cut_up.select(*keep, F.posexplode(F.arrays_zip(
        "found",
        # with the candidate before it, which can be its name; long enough for all of VALUE's lookbehind
        F.transform("between", lambda s, i: F.right(F.concat(F.when(i > 0, F.get("found", i - 1)).otherwise(F.lit("")), s), F.lit(80))).alias("before"),
        F.transform(F.expr("slice(between, 2, size(between))"), lambda s: F.substring(s, 1, 20)).alias("after"),
    )).alias("ordinal", "z")).filter("z.found IS NOT NULL")
    before = F.coalesce("z.before", F.lit(""))
    # the point or hyphen after a run is the sentence's; values and headers stay as they are
    candidate = F.when(before.rlike(NAMES) | F.col("z.found").startswith("-----BEGIN "), F.col("z.found")).otherwise(F.regexp_replace("z.found", r"[.\-]+$", ""))
    each = each.select(*keep, "ordinal", candidate.alias("candidate"), before.alias("before"), F.coalesce("z.after", F.lit("")).alias("after"))
    return each.filter((F.length("candidate") >= 12) | F.col("before").rlike(NAMES))


def letter_pairs(counts: DataFrame) -> list[float]:
    """Log probabilities of a letter after another one, 26 for each first letter, from words (w) and their counts; every pair
    counts once more than it is seen."""
    pairs = counts.select("count", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("p")).groupBy("p").agg(F.sum("count").alias("n"))
    seen = {r.p: r.n for r in pairs.collect()}  # of 26 letters
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [math.log((seen.get(x + y, 0) + 1) / (sum(seen.get(x + z, 0) for z in letters) + 26)) for x in letters for y in letters]


def described(found: DataFrame, words: list[str], pairs: list[float]) -> DataFrame:
    """Adds the features; `words` is the dictionary, `pairs` the model of letter pairs."""
    classes = F.translate("candidate", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0" * 10 + "A" * 26 + "a" * 26)
    known = "(?i)" + "|".join(sorted(words, key=lambda w: (-len(w), w))) if words else "(?!)"
    model = F.array(*[F.lit(x) for x in pairs])
    # one pass over the characters: the letter before (0 to 25, -1 for others), sum and number of the pairs
    letters = F.transform(F.split(F.lower("candidate"), ""), lambda ch: F.when(ch.between("a", "z"), F.ascii(ch) - 97).otherwise(-1))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def step(t: Column, x: Column) -> Column:
        pair = (t["last"] >= 0) & (x >= 0)
        return F.struct(x.alias("last"), F.when(pair, t["sum"] + F.get(model, t["last"] * 26 + x)).otherwise(t["sum"]).alias("sum"), F.when(pair, t["n"] + 1).otherwise(t["n"]).alias("n"))

    likely = F.aggregate(letters, start, step, lambda t: F.coalesce(F.try_divide(t["sum"], t["n"]), F.lit(-math.log(26))))
    return found.withColumns({
        "length": F.length("candidate").cast("double"), "digits": _share("[^0-9]"), "upper": _share("[^A-Z]"), "lower": _share("[^a-z]"), "other": _share("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
        "changes": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / F.length("candidate"),
        "pairs": likely, "hexadecimal": F.col("candidate").rlike("^[0-9a-f]+$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace("candidate", known, "")) / F.length("candidate"),
        "slashes": F.length(F.regexp_replace("candidate", "[^/]", "")).cast("double"), "dots": F.length(F.regexp_replace("candidate", "[^.]", "")).cast("double"),
        "at": F.col("candidate").contains("@").cast("double"), "in_link": F.col("before").rlike(r"(?i)(?:https?:|www\.|/)\S*$").cast("double"),
        "named": F.right("before", F.lit(40)).rlike(NAME).cast("double"), "assigned": F.col("before").rlike("[=:][\"' ]*$").cast("double"),
        "quoted": F.col("before").rlike("[\"']$").cast("double"), "ends": F.col("after").rlike("^[\"';,)\\s]|^$").cast("double"),
    })


def ruled() -> Column:
    """What the rules say of a candidate: a key of a known format, or a value of any length assigned to a name for a secret,
    is one; a value of one repeated character is a placeholder; of a short value of letters alone (a word of prose as well
    as a weak password) they say nothing, so it isn't labelled."""
    value, plain = F.col("before").rlike(NAMES), F.col("candidate").rlike(r"^(.)\1*$")
    unclear = (F.length("candidate") < 12) & F.col("candidate").rlike(r"^\p{L}*$")
    return F.when(F.col("candidate").rlike(KNOWN), True).when(~value | plain, False).when(~unclear, True)


def scan(docs: DataFrame, labels: Column | None = None, sample_findings: int = 20_000, dictionary_words: int = 150, trees: int = 20, depth: int = 5, threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ordinal, candidate, before, score, is_secret."""
    docs = docs.select("doc_id", "text")
    counts = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<!\p{L})[a-z]{3,12}(?!\p{L})"), 0)).alias("w")).groupBy("w").count()
    counts = cut(counts)
    words = [r.w for r in counts.orderBy(F.col("count").desc(), "w").limit(dictionary_words).collect()]
    found = described(cut(candidates(docs, ["doc_id"])), words, letter_pairs(counts))
    place = F.xxhash64("doc_id", "ordinal", "candidate", "before") / F.lit(2.0**64) + 0.5
    labelled = found.withColumns({"label": (ruled() if labels is None else labels).cast("double"), "place": place}).filter("label IS NOT NULL")
    kinds = {r.label: r for r in labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("place").alias("first")).collect()}
    if set(kinds) == {0.0, 1.0}:
        share = {k: min(1.0, sample_findings / r.n) for k, r in kinds.items()}
        of_kind = lambda x: F.when(F.col("label") == 1, F.lit(x[1.0])).otherwise(F.lit(x[0.0]))
        # the first of each kind is in, though all its findings have one hash
        train = labelled.filter(F.col("place") <= of_kind({k: max(s, kinds[k].first) for k, s in share.items()}))
        train = cut(train.select("label", (1 / of_kind(share)).alias("weight"), *FEATURES))
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, maxBins=32, subsamplingRate=1.0, weightCol="weight").fit(assemble.transform(train))
        scored = forest.transform(assemble.transform(found)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    else:
        scored = found.withColumn("score", F.coalesce(ruled(), F.lit(False)).cast("double"))
    return scored.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "candidate", "before", "score", (F.col("score") >= threshold).alias("is_secret"))


def op9_secret_forest(spark, sf_dir: str) -> DataFrame:
    """A row per candidate, with a digest in place of the candidate itself."""
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "ordinal", F.length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


QUERIES = {"op9_secret_forest": op9_secret_forest}
SQL: dict[str, str] = {}
