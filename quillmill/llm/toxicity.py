"""Problem 9: abusive, hateful or sexual content, scored passage by passage with subword-bag embeddings.

A passage is the mean of the embeddings of its words' character n-grams, words and word pairs; a linear softmax on top
is trained jointly with them in numpy, on the labelled documents alone. Labels are given for documents, so training
alternates between choosing the passages that carry a document's label and fitting them. A document's score is that of
its worst passage. Misspelt words share n-grams with those of the labelled documents; harmful words and turns that no
labelled document holds in any form cannot be found.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BUCKETS, DIM, GRAMS = 1 << 18, 16, (3, 4, 5)
SCALE = 8.0  # of the mean embedding, so that bags of many parts can move the softmax

# fixed values: letters that look like Latin ones, and digits and signs written for letters
LOOKALIKES = str.maketrans(
    "аеорсухіјѕԁһкмтвнгпьАВЕКМНОРСТХІЈЅοαεινυρτκηχβΑΒΕΖΗΙΚΜΝΟΡΤΥΧıłøđ",
    "aeopcyxijsdhkmtbhrnbabekmhopctxijsoaeivuptknxbabezhikmnoptyxilod",
)
LEET = str.maketrans("013457@$€", "oieastase")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufe00-\ufe0f\ufeff]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ ._\-*]){3,}[^\W_](?![^\W_])")
_APART = re.compile(r"[ ._\-*]")
_WORD = re.compile(r"[^\W_]+(?:[*#%@$!][^\W_]+)*[*#$]*|[\U0001f300-\U0001faff]")
_TAG = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>", re.IGNORECASE)
_GAP = re.compile(r"(?<=[.!?。！？…🖕])\s+|(?<=[。！？])|(?<=:)\s+|[\r\n]+")
_REPEATED = re.compile(r"(.)\1{2,}")
_MASK = re.compile(r"[*#%!]+")


def plain(text: str) -> str:
    """Lower case without marks, tags, invisible characters, look-alike letters and spread-out words."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text).translate(LOOKALIKES)
        text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return _SPACED.sub(lambda m: _APART.sub("", m[0]), _TAG.sub("\n", text).lower())


def respelt(w: str) -> str:
    """A word without repeated letters, digits for letters, and with one sign for each mask; '0' for a number."""
    w = _REPEATED.sub(r"\1", w)
    if w.isalpha():
        return w
    if any(ch.isalpha() for ch in w) and any(ch in "013457@$€" for ch in w):
        w = w.translate(LEET)
    return "0" if w.isdigit() else _MASK.sub("*", w)


class _Cached(dict):
    """Results of a function of one word, forgotten beyond a bound."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, w):
        if len(self) > 200_000:
            self.clear()
        got = self[w] = self.of(w)
        return got


def passages(text: str, spelling: dict | None = None) -> list[list[str]]:
    """The words of each sentence or line, what stands before a colon apart; scraps of up to three letters join the
    passage before them, so every word is in one."""
    spell = (_Cached(respelt) if spelling is None else spelling).__getitem__
    out: list[list[str]] = []
    short = True
    for p in _GAP.split(plain(text)):
        ws = _WORD.findall(p) if p else None
        if not ws:
            continue
        ws = list(map(spell, ws))
        scrap = sum(map(len, ws)) < 4
        if out and (scrap or short):
            out[-1] += ws
        else:
            out.append(ws)
        short = scrap and short
    return out


def words(passage: str) -> list[str]:
    return [w for p in passages(passage) for w in p]


def word_features(w: str) -> list[int]:
    """Buckets of a word: itself and its character n-grams; a masked letter (*) joins what stands around it."""
    out = [zlib.crc32(("w" + w).encode()) % BUCKETS]
    form = f"<{w.replace('*', '')}>"
    for n in GRAMS:
        out += [zlib.crc32(form[i : i + n].encode()) % BUCKETS for i in range(len(form) - n + 1)]
    if "*" in w:
        out.append(zlib.crc32(b"masked") % BUCKETS)
    return out


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, from the words' hashes."""
    h = hashes.astype(np.uint64)
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def _hashes(words_) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in words_], np.int64)


def features(ws: list[str], known: dict | None = None) -> np.ndarray:
    known = _Cached(word_features) if known is None else known
    parts = [f for w in ws for f in known[w]]
    return np.concatenate((np.asarray(parts, np.int64), pair_features(_hashes(ws))))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Embeddings ``e`` and the difference ``u`` of the two softmax rows, with bias ``b``."""

    def __init__(self, e: np.ndarray, u: np.ndarray, b: float):
        self.b = float(b)
        self.weight = (e @ u).astype(np.float64)  # one number a bucket: the logit is linear in the bag

    @staticmethod
    def fit(bags: list[np.ndarray], y: np.ndarray, w: np.ndarray, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> "Model":
        """Adagrad over batches; ``w``: weights of the bags."""
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        u, b = rng.normal(0, 1, DIM).astype(np.float32), 0.0
        ge, gu, gb = np.full(BUCKETS, 1e-3, np.float32), np.full(DIM, 1e-3, np.float32), 1e-3
        sizes = np.array([len(x) for x in bags], np.int64)
        flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
        begin = np.cumsum(sizes) - sizes
        y, w = np.asarray(y, np.float32), np.asarray(w, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), 128):
                at = order[k : k + 128]
                lens = sizes[at]
                starts = np.cumsum(lens) - lens
                each = np.repeat(np.arange(len(at)), lens)
                ids = flat[np.repeat(begin[at] - starts, lens) + np.arange(len(each))]
                h = np.add.reduceat(e[ids], starts, axis=0) / lens[:, None] * SCALE
                err = (_sigmoid(h @ u + b) - y[at]) * w[at]
                d = ((err / lens)[:, None] * u * SCALE).astype(np.float32)
                du = err @ h + 1e-4 * u
                gu += du * du
                gb += float(err.sum()) ** 2
                u, b = u - rate * du / np.sqrt(gu), b - rate * float(err.sum()) / gb**0.5
                by = np.argsort(ids)
                sorted_ids = ids[by]
                first = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
                rows = sorted_ids[first]
                step = np.add.reduceat(d[each[by]], first, axis=0)
                ge[rows] += (step * step).mean(axis=1)
                e[rows] -= rate * step / np.sqrt(ge[rows])[:, None]
        return Model(e, u, b)

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.array([_sigmoid(self.weight[x].mean() * SCALE + self.b) for x in bags])

    def score_texts(self, texts) -> np.ndarray:
        """The worst passage of each text, a batch at once: each distinct word is looked up once."""
        ids: dict[str, int] = {}
        spelling = _Cached(respelt)
        flat: list[int] = []
        ends: list[int] = []  # of the passages
        owner: list[int] = []
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            for ws in passages(t, spelling) if t else ():
                flat += [ids.setdefault(w, len(ids)) for w in ws]
                ends.append(len(flat))
                owner.append(i)
        if not ends:
            return out
        own = [word_features(w) for w in ids]
        count = np.array([len(f) for f in own])
        total = np.add.reduceat(self.weight[np.concatenate([np.asarray(f) for f in own])], np.cumsum(count) - count)
        at, stop = np.asarray(flat), np.asarray(ends)
        begin = np.concatenate(([0], stop[:-1]))
        pair = self.weight[pair_features(_hashes(ids)[at])] if len(at) > 1 else np.zeros(0)
        pair = np.append(pair, 0.0)
        pair[stop - 1] = 0.0  # no pair spans two passages
        logit = np.add.reduceat(total[at] + pair, begin)
        n = np.add.reduceat(count[at], begin) + (stop - begin) - 1
        np.maximum.at(out, np.asarray(owner), _sigmoid(logit / n * SCALE + self.b))
        return out

    def bytes(self) -> bytes:
        """What scoring needs: one number a bucket, and the bias (1 MB whatever the data)."""
        return np.append(self.weight, self.b).astype(np.float32).tobytes()

    @staticmethod
    def of(raw: bytes) -> "Model":
        a = np.frombuffer(raw, np.float32)
        return Model(a[:-1, None], np.ones(1, np.float32), float(a[-1]))


def train(texts: list[str], labels: list[tuple[float, int]], rounds: int = 3, folds: int = 3, seed: int = 7) -> Model | None:
    """``labels``: share of annotators that call the document toxic, and their number. None where no label is toxic.

    Passages of clean documents are clean and a toxic document has a toxic passage, but annotators err. In each round
    the documents are split in folds by text, and a model of the others judges the passages of each. At first all
    passages of toxic documents count as toxic, by their share of votes; those that clean documents hold, too, are
    outvoted. What is judged toxic is then fitted in full, and passages of clean documents that look toxic are left out.
    """
    spelling, known = _Cached(respelt), _Cached(word_features)
    docs = [passages(t or "", spelling) for t in texts]
    of_text = np.array([zlib.crc32((t or "").encode()) % folds for t in texts], np.int64)
    clean: dict[tuple, int] = {}
    suspects: list[tuple[list, float, int, int]] = []
    for d, (y, n), f in zip(docs, labels, of_text.tolist()):
        if y == 0:
            for p in d:
                clean[(f, *p)] = clean.get((f, *p), 0) + 1
        elif d:
            suspects.append(([(len(p), features(p, known)) for p in d], y, n, f))
    if not suspects:
        return None
    good = [features(list(p[1:]), known) for p in clean]
    fold_of_good = np.array([p[0] for p in clean], np.int64)
    times = np.array(list(clean.values()), np.float64)  # equal passages are fitted once, with their number as weight
    kept = np.ones(len(good), dtype=bool)
    chosen = {(i, j): y for i, (d, y, _, _) in enumerate(suspects) for j in range(len(d))}

    def fit(left_out: int | None, seed_: int, epochs: int, first: bool = False) -> Model:
        own = [(suspects[i][0][j][1], w) for (i, j), w in chosen.items() if suspects[i][3] != left_out]
        neg = np.flatnonzero(kept if left_out is None else kept & (fold_of_good != left_out))
        ratio = min(6.0, max(1.0, times[neg].sum() / (8 * max(1, len(own)))))
        y = np.array([1.0] * len(own) + [0.0] * len(neg))
        w = np.concatenate(([x if first else ratio * x for _, x in own], times[neg]))
        return Model.fit([b for b, _ in own] + [good[k] for k in neg], y, w, epochs=epochs, seed=seed_)

    for r in range(rounds):
        models = [fit(f, seed + folds * r + f, 5, r == 0) for f in range(folds)]
        if r:
            for f in range(folds):
                mine = np.flatnonzero(fold_of_good == f)
                kept[mine] = models[f].scores([good[k] for k in mine]) < 0.8
        chosen = {}
        for i, (d, y, n, f) in enumerate(suspects):
            s = models[f].scores([b for _, b in d])
            agreed = y == 1 and n > 1
            for k, x in enumerate(s):
                if d[k][0] > 2 and (x >= (0.6 if r else 0.8) or (agreed and k == int(np.argmax(s)) and x >= 0.1)):
                    chosen[i, k] = 1.0  # scraps of one or two words stand beside harmful passages as beside others
    return fit(None, seed + 99, 8)


def toxicity(documents: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """``doc_id, score`` of every document, the score in [0, 1] being that of its worst passage.

    ``labels``: ``doc_id, toxic`` (0/1; several annotators may disagree). The model is fitted on at most
    ``max_labelled`` labelled documents (all, as long as there are no more; else those with the least hash of their id),
    in one task, and is of fixed size (1 MB), so it may be broadcast. Every document is scored on its whole text. Null
    or empty texts score 0; labels without a document, or null ones, are left out; without a document that is labelled
    toxic all scores are 0; an empty table gives no rows.
    """
    spark = documents.sparkSession
    votes = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("y"), F.count("*").cast("int").alias("n"))
    sample = votes.orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    fit_on = documents.select("doc_id", "text").filter(F.length("text") > 0).join(sample, "doc_id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        model = train(list(pdf["text"]), list(zip(pdf["y"], pdf["n"])))
        return pd.DataFrame({"raw": [model.bytes()] if model else []}, dtype=object)

    rows = fit_on.groupBy(F.lit(0).alias("one")).applyInPandas(fit, "raw binary").collect()  # one row of 1 MB
    if not rows:
        return documents.select("doc_id", F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast(bytes(rows[0]["raw"]))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.of(sent.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score_texts(list(pdf["text"]))})

    return documents.select("doc_id", "text").mapInPandas(score, "doc_id long, score double")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "doc_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).filter("score >= 0.5").select("doc_id")


def p9_toxicity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, mean score and rate of toxic ones per source."""
    src = C.table(spark, sf_dir, "documents").select("doc_id", "source")
    return (
        _scores(spark, sf_dir)
        .join(src, "doc_id")
        .groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg((F.col("score") >= 0.5).cast("int")), 6).alias("rate"))
    )


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_toxicity_report": p9_toxicity_report}
