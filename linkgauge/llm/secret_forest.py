"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters, and quoted or assigned values behind a telling name. Features are
their length, character transitions, dictionary coverage, where they stand in a path, and the words
around them. The forest is trained on labelled findings.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 5
TREES, DEPTH = 60, 8
DICTIONARY = 5_000  # most common words of the corpus that count as a dictionary; bounds what is broadcast
MAX_LABELLED = 200_000  # bound of the training table

_CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}"
    r"|(?i:(?:password|passwd|pwd|secret|token|api_?key|auth)[\"']?\s?[=:]\s?[\"']?)(?P<value>[^\s\"']{8,})"
)
_WORD = re.compile(r"[A-Za-z]+")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
# Words near a finding
SECRET_WORDS = {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "auth", "credential", "credentials", "private", "access", "bearer"}
HARMLESS_WORDS = {"example", "sample", "commit", "hash", "sha", "md5", "checksum", "digest", "uuid", "id", "version", "phone", "page", "test", "dummy", "placeholder",
                  "your", "build", "order", "isbn", "call", "number", "image", "data", "fixture"}
FEATURES = ["length", "class_changes", "bigram", "digits", "uppers", "distinct", "entropy", "hex", "uuid", "dictionary", "slashes", "hyphens",
            "after_slash", "path_harmless", "assigned", "quoted", "secret_before", "harmless_before", "harmless_after", "harmless_inside"]


def _class(ch: str) -> int:
    return 0 if ch.isdigit() else 1 if ch.islower() else 2 if ch.isupper() else 3


class Language:
    """What ordinary text looks like: letter bigrams and common words of the whole corpus."""

    def __init__(self, bigrams: np.ndarray, words: list[str]):
        rows = bigrams + 1.0
        self.logs = np.log2(rows / rows.sum(axis=1, keepdims=True)) + math.log2(26)
        self.words, self.longest = set(words), max(map(len, words), default=0)

    def bigram(self, text: str) -> float:
        low = [ord(c) - 97 for c in text.lower() if "a" <= c <= "z"]
        return float(np.mean([self.logs[a, b] for a, b in zip(low, low[1:], strict=False)])) if len(low) > 1 else -2.0

    def coverage(self, text: str) -> float:
        """Share of the characters in dictionary words, found greedily from the left."""
        low, i, found = text.lower(), 0, 0
        while i < len(low):
            for n in range(min(self.longest, len(low) - i), 2, -1):
                if low[i : i + n] in self.words:
                    found, i = found + n, i + n
                    break
            else:
                i += 1
        return found / max(1, len(low))


def features(text: str, start: int, end: int, path: str, language: Language) -> list[float]:
    found, before, after = text[start:end], text[max(0, start - 60) : start], text[end : end + 40]
    n = len(found)
    counts = [found.count(c) / n for c in set(found)]
    near = {w.lower() for w in _WORD.findall(before)[-4:]}
    behind = {w.lower() for w in _WORD.findall(after)[:3]}
    inside = {w.lower() for w in _WORD.findall(found)}
    folder = {w.lower() for w in _WORD.findall(path)}
    bare = before.rstrip(" \"'")
    return [float(x) for x in (
        n, sum(_class(a) != _class(b) for a, b in zip(found, found[1:], strict=False)) / max(1, n - 1), language.bigram(found),
        sum(c.isdigit() for c in found) / n, sum(c.isupper() for c in found) / n, len(set(found)) / n, -sum(p * math.log2(p) for p in counts),
        all(c in "0123456789abcdefABCDEF" for c in found), bool(_UUID.fullmatch(found)), language.coverage(found),
        found.count("/") / n, found.count("-") / n, before.endswith(("/", "\\", ".", "@")), bool(folder & HARMLESS_WORDS),
        bare.endswith(("=", ":")), before.endswith(("\"", "'")) and after[:1] in ("\"", "'"), bool(near & SECRET_WORDS), bool(near & HARMLESS_WORDS),
        bool(behind & HARMLESS_WORDS), bool(inside & HARMLESS_WORDS))]


def spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidates of a whole text, in order, without overlaps."""
    for m in _CANDIDATE.finditer(text):
        yield m.span("value") if m["value"] else m.span()


def language_of(docs: DataFrame, text: str = "text") -> Language:
    """Bigrams and common words, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(676, dtype=np.int64)
        for batch in batches:
            for value in batch["text"]:
                letters = np.frombuffer(value.as_py().encode("utf-8", "surrogatepass").lower(), np.uint8).astype(np.int16) - 97
                pair = (letters[:-1] >= 0) & (letters[:-1] < 26) & (letters[1:] >= 0) & (letters[1:] < 26)
                total += np.bincount(letters[:-1][pair] * 26 + letters[1:][pair], minlength=676)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(676)), pa.array(total)], names=["pair", "n"])

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    bigrams = np.zeros(676)
    for r in rows.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        bigrams[r.pair] = r.n
    words = rows.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(3, 16))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY)
    return Language(bigrams.reshape(26, 26), [r.word for r in top.collect()])


def candidates(docs: DataFrame, language: Language, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, start, length, value, f (features): a row for each candidate; null texts have none."""
    sent = docs.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, value, folder in zip(batch["doc_id"].to_pylist(), batch["text"], batch["path"].to_pylist(), strict=True):
                whole = value.as_py()
                for start, end in spans(whole):
                    for column, x in zip(out, (doc, start, end - start, whole[start:end], features(whole, start, end, folder or "", known)), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "value", "f"])

    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.col(path).cast("string") if path in docs.columns else F.lit("")).alias("path"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, value string, f array<double>")


def labelled_findings(seed: int = SEED, rows: int = 1200) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, path, label) built by a rule: real-looking secrets and common false positives."""
    draw = random.Random(seed)
    pick = lambda letters, n: "".join(draw.choice(letters) for _ in range(n))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    plain, low = b64[:62], "abcdefghijklmnopqrstuvwxyz"
    words = ["the", "and", "river", "bridge", "with", "from", "that", "over", "water", "market", "house", "stone"]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    good = [
        lambda: (draw.choice(['token = "', 'api_key: "', 'secret="', "auth_token = '", 'password = "', "access key: "]), pick(hexa, draw.choice([32, 40, 64])), '"'),
        lambda: (draw.choice(['secret_key = "', "aws_secret: ", "bearer "]), pick(b64, 40), ""),
        lambda: (draw.choice(["key = ", "export TOKEN=", ""]), draw.choice(["AKIA", "ghp_", "sk_live_", "xoxb-"]) + pick(plain, draw.choice([16, 24, 36])), ""),
        lambda: (draw.choice(["password: ", "pwd='", "passwd = "]), pick(plain, 10) + draw.choice("!$%#@") + pick(plain, 3), ""),
        lambda: ("", pick(hexa, 40), ""),
    ]
    bad = [
        lambda: (draw.choice(["id ", "uuid: ", "request "]), "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), ""),
        lambda: (draw.choice(["commit ", "sha ", "checksum: ", "md5 hash "]), pick(hexa, draw.choice([32, 40])), ""),
        lambda: (draw.choice(["call ", "order number ", "isbn ", ""]), pick("0123456789", draw.choice([16, 18, 20])), ""),
        lambda: ("https://host.example/", "/".join([draw.choice(words), pick("0123456789", 4), "-".join(draw.choice(words) for _ in range(4))]), ".html"),
        lambda: (draw.choice(["token = ", "your key: ", "password: "]), draw.choice(["your-api-key-here-123", "example_token_123456", "xxxxxxxxxxxx", "changeme-placeholder1", "test_dummy_value_1"]), ""),
        lambda: ("", "-".join(draw.choice(words) for _ in range(4)) + "-" + pick("0123456789", 2), ""),
        lambda: ("", draw.choice(words).title() + draw.choice(words).title() + draw.choice(words).title() + "V" + pick("0123456789", 1), "("),
        lambda: ("", "_".join(draw.choice(words) for _ in range(3)) + "_2021_05_" + pick("0123456789", 2), ""),
        lambda: ("password: ", draw.choice(words) + draw.choice(words), ""),
        lambda: ("image data ", pick(b64, draw.choice([120, 300])), "=="),
        lambda: ("", pick(low[:10], 3) + "/" + draw.choice(words) + "/" + draw.choice(words) + "/v1/" + draw.choice(words), ""),
    ]
    out = []
    for i in range(rows):
        before, value, after = draw.choice(good if i % 2 else bad)()
        head = some(3) + " " + before
        out.append((head + value + after + " " + some(3), len(head), len(head) + len(value), draw.choice(["src/app", "conf", "src7", "docs"]) if i % 2 else draw.choice(["src/app", "test/fixture", "src7"]), i % 2))
    return out


def fit(spark: SparkSession, findings: list[tuple[str, int, int, str, int]], language: Language, seed: int = SEED) -> RandomForestClassificationModel:
    """The forest of labelled findings (text, start, end, path, label), at most ``MAX_LABELLED`` of them."""
    if len(findings) > MAX_LABELLED:
        findings = random.Random(seed).sample(findings, MAX_LABELLED)
    table = spark.createDataFrame([(*features(t, a, b, p, language), float(y)) for t, a, b, p, y in findings], ", ".join(f"{f} double" for f in [*FEATURES, "label"]))
    return RandomForestClassifier(featuresCol="v", numTrees=TREES, maxDepth=DEPTH, seed=seed).fit(VectorAssembler(inputCols=FEATURES, outputCol="v").transform(table.coalesce(1)))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", findings: list | None = None) -> DataFrame:
    """doc_id, start, length (code points), value, probability, is_secret: a row for each candidate.

    Repeated rows and null keys give rows of their own; null, empty and candidate-free texts give none; an
    empty table gives none. A missing or null path counts as empty. Other columns are not read.
    """
    language = language_of(docs, text)
    forest = fit(docs.sparkSession, findings or labelled_findings(), language)
    found = candidates(docs, language, key, text, path)
    flat = found.select("doc_id", "start", "length", "value", *[F.col("f")[i].alias(n if n != "length" else "size") for i, n in enumerate(FEATURES)])
    vector = VectorAssembler(inputCols=[n if n != "length" else "size" for n in FEATURES], outputCol="v")
    scored = forest.transform(vector.transform(flat))
    return scored.select("doc_id", "start", "length", "value", vector_to_array("probability")[1].alias("probability"), (F.col("prediction") == 1.0).alias("is_secret"))
