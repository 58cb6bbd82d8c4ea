"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors.

Voters vote for toxic or abstain. Some are fixed: lexicons of insults and threats in four languages, and patterns on the
form of a text. No lexicon written in advance knows words that it has never met, so others are induced: single words and
word beginnings that cover labelled training rows which no voter covers yet, and that are rare in other rows.

The label model has a class and a tree of dependencies between voters: P(vote | class, parent's vote). The tables hold the
voters' accuracies, and those of pairs along the tree their correlations; the tree is the one of most mutual information
given the class. Both are estimated on the labelled training rows. The given label is no voter: a row's posterior comes
from its votes alone, so that a label against all votes counts little.

Logistic weights over hashed words and beginnings are fitted to the posteriors. How rare a feature must be elsewhere is
chosen by cross-validation among training rows. Every whole text is then scored by the weights, which have a fixed size.

Counts of features are made on the executors; the driver gets at most ``CANDIDATES`` counts, and of at most
``SAMPLE_ROWS`` rows those features that are among at most ``USED``.

Defined cases: null and empty texts get the score of a text without known words; texts of any length are read whole, and
count once for each feature; without labels of both kinds every score is 0; a null label teaches nothing; of repeated
labels of a row the highest counts, and repeated rows are scored each; equal features are ordered by number; an empty
table gives no rows; extra columns don't matter, whatever their names.
"""

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.batches import pieces
from quillspark.plans.staging import Stage

#: Bounds of the fit: labelled rows, hashed features, features that are counted and that weights may use.
SAMPLE_ROWS, BUCKETS, CANDIDATES, USED = 24_000, 1 << 20, 20_000, 2_000
#: Induced voters at most; toxic rows that a feature needs; choices of the log ratio of a feature's rates and of its share of toxic rows.
INDUCED, LEAST_ROWS = 40, 3
CHOICES = ((3.5, 0.008), (3.0, 0.008), (2.5, 0.008), (2.5, 0.003), (2.0, 0.008))
FOLDS, ROUNDS, STEPS, RIDGE = 3, 15, 120, 2e-4
STRIP = ".,;:!?\"'()[]{}<>*_-#$%&|"
BEGINNINGS = (4, 5)
#: Words of insult, contempt, disgust, threat and abuse in English, French, German and Spanish; none that is a common word of another of these languages.
LEXICONS = {
    "dull": "idiot idiots moron morons stupid dumb imbecile cretin dimwit fool brainless halfwit "
    "imbécile imbéciles stupide crétin débile abruti dummkopf trottel blöd blödmann schwachkopf dumm depp "
    "estúpido estúpida imbécil tonto tonta idiota idiotas cretino bobo",
    "worthless": "worthless loser losers pathetic useless trash garbage rubbish scum vermin parasite clown "
    "minable raté inutile déchet ordure vermine clochard bouffon versager wertlos abschaum müll gesindel clown erbärmlich "
    "inútil perdedor basura escoria patético payaso fracasado",
    "disgust": "disgusting filthy vile revolting repulsive nasty sickening dégoûtant répugnant immonde "
    "ekelhaft widerlich abstoßend dreckig asqueroso repugnante sucio inmundo",
    "threat": "kill murder strangle destroy crève crever tuer détruire umbringen verrecken töten "
    "matar destruir",
    "hate": "hate despise loathe detest haïr déteste haine hasse verachte hass odio odiar detesto desprecio",
    "abuse": "bastard jerk creep freak pig swine liar coward connard salaud lâche menteur porc cochon "
    "schwein mistkerl feigling lügner ratte bastardo cerdo cobarde mentiroso rata canalla",
}
_LEXICON = {w: k for k, words in enumerate(LEXICONS.values()) for w in words.split()}
FIXED = len(LEXICONS) + 3


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


class Features:
    """Hashed features of words, and the lexicons that hold them, remembered by word."""

    def __init__(self, kept: np.ndarray | None = None):
        self.kept, self.memo = kept, {}

    def of_word(self, word: str) -> tuple[tuple[int, ...], int]:
        w = word.strip(STRIP).lower()
        if not w:
            return (), -1
        ids = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (w, *("^" + w[:n] for n in BEGINNINGS if len(w) >= n))]
        return tuple(ids) if self.kept is None else tuple(i for i in ids if self.kept[i]), _LEXICON.get(w, -1)

    def __call__(self, text: str) -> tuple[set[int], set[int]]:
        """Features, and lexicons with a word in the text."""
        memo, out, held = self.memo, set(), set()
        if len(memo) > 400_000:
            memo.clear()
        for word in set(text.split()):
            found = memo.get(word)
            if found is None:
                found = memo[word] = self.of_word(word)
            if found[0]:
                out.update(found[0])
            if found[1] >= 0:
                held.add(found[1])
        return out, held


def patterns(text: str) -> list[bool]:
    """Votes on the form of the text: mostly capitals, many exclamation marks, letters drawn out."""
    letters, capitals = len(re.findall(r"[^\W\d_]", text)), len(re.findall(r"[A-ZÀ-Þ]", text))
    return [letters > 0 and capitals > 0.5 * letters, text.count("!") > 0.01 * len(text) + 2, re.search(r"([^\W\d_])\1{3,}", text) is not None]


@dataclass
class Taught:
    """Labelled rows: votes of the fixed voters, labels, folds, and the numbers of the features that rows hold."""

    votes: np.ndarray
    label: np.ndarray
    fold: np.ndarray
    row: np.ndarray
    col: np.ndarray
    #: The hashed feature of each number.
    ids: np.ndarray

    def only(self, keep: np.ndarray) -> "Taught":
        place = np.cumsum(keep) - 1
        at = keep[self.row]
        return Taught(self.votes[keep], self.label[keep], self.fold[keep], place[self.row[at]], self.col[at], self.ids)


def teach(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Taught | None:
    """At most SAMPLE_ROWS labelled rows (in expectation; a hash of the id picks them), without held-out ones; None without both labels."""
    stage = Stage(spark, "toxicity")
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_l")).groupBy("_id").agg(F.max("_l").alias("_y"))
    n = known.count()
    if n > SAMPLE_ROWS:
        known = known.where(F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE_ROWS / n))
    known = known.orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(SAMPLE_ROWS)
    known = known.select("_id", "_y", F.pmod(F.xxhash64(F.lit(6), "_id"), F.lit(FOLDS)).cast("int").alias("_fold"))

    def run(batches):
        features = Features()
        for batch, texts in pieces(batches, "_text"):
            found = [features(t) for t in texts]
            votes = [[k in held for k in range(len(LEXICONS))] + patterns(t) for t, (_, held) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sorted(f) for f, _ in found], pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.bool_())), pa.array([int(y > 0) for y in batch.column("_y").to_pylist()], pa.int32()), batch.column("_fold")],
                ["f", "v", "y", "fold"],
            )

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = stage.write(texts.join(F.broadcast(known), "_id").select("_text", "_y", "_fold").mapInArrow(run, "f array<int>, v array<boolean>, y int, fold int"), "rows")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    if not 0 < size["t"] < size["n"]:
        return None
    held = rows.select("y", F.explode("f").alias("f"))
    often = held.where("y = 1").groupBy("f").agg(F.count("*").alias("t")).where(F.col("t") >= LEAST_ROWS).orderBy(F.desc("t"), "f").limit(CANDIDATES)
    counts = held.join(F.broadcast(often), "f").groupBy("f").agg(F.first("t").alias("t"), F.sum(1 - F.col("y")).alias("o")).toPandas()  # at most CANDIDATES rows
    toxic, rest = counts["t"].to_numpy(dtype=float), counts["o"].to_numpy(dtype=float)
    ratio = np.log((toxic + 0.3) / (size["t"] + 1)) - np.log((rest + 0.3) / (size["n"] - size["t"] + 1))
    ids = counts["f"].to_numpy(dtype=np.int64)
    able = np.flatnonzero(ratio >= min(r for r, _ in CHOICES) - 0.5)
    ids = np.sort(ids[able[np.lexsort((ids[able], -(ratio * np.sqrt(toxic))[able]))][:USED]])
    kept = np.full(BUCKETS, -1, dtype=np.int32)
    kept[ids] = np.arange(len(ids))

    def narrow(batches):
        for batch in batches:
            f = [[k for k in kept[np.array(x, dtype=np.int64)].tolist() if k >= 0] if x else [] for x in batch.column("f").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.int32())), batch.column("v"), batch.column("y"), batch.column("fold")], ["f", "v", "y", "fold"])

    got = rows.mapInArrow(narrow, rows.schema).toPandas()
    lists = [np.asarray(x, dtype=np.int64) for x in got["f"]]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    votes = np.array([list(x) for x in got["v"]], dtype=bool).reshape(len(lists), FIXED)
    return Taught(votes, got["y"].to_numpy() > 0, got["fold"].to_numpy(), row, np.concatenate(lists) if lists else row, ids)


class LabelModel:
    """P(class) and P(vote | class, parent's vote) along a tree of voters; the root's parent never votes."""

    def __init__(self, votes: np.ndarray):
        self.votes, v = votes.astype(int), votes.shape[1]
        self.prior, self.parent = 0.5, np.full(v, -1)
        #: table[c, i, u]: the chance that voter i votes in class c if its parent's vote is u.
        self.table = np.full((2, v, 2), 0.5)

    def pairs(self, post: np.ndarray) -> np.ndarray:
        """Smoothed joint rates [class, vote of i, vote of j, i, j]."""
        out, x = [], self.votes.astype(float)
        for w in (1 - post, post):
            both, one, total = (x.T * w) @ x, w @ x, w.sum()
            grid = np.array([[total - one[:, None] - one[None, :] + both, one[None, :] - both], [one[:, None] - both, both]])
            out.append((grid + 0.05) / (total + 0.2))
        return np.array(out)

    def maximise(self, post: np.ndarray) -> None:
        """The likeliest tree and tables if the rows are of class 1 with these chances."""
        rates, v = self.pairs(post), self.votes.shape[1]
        self.prior = float(np.clip(post.mean(), 1e-4, 1 - 1e-4))
        share = np.array([1 - self.prior, self.prior])
        own, other = rates.sum(axis=2), rates.sum(axis=1)  # [class, vote, i, j]
        given = (rates * np.log(rates / (own[:, :, None] * other[:, None]))).sum(axis=(1, 2))
        shared = np.tensordot(share, given, axes=1)
        np.fill_diagonal(shared, -1)
        # the tree of most mutual information, from voter 0 on
        best, near, inside = shared[0].copy(), np.zeros(v, dtype=int), np.zeros(v, dtype=bool)
        inside[0], self.parent = True, np.full(v, -1)
        for _ in range(v - 1):
            k = int(np.argmax(np.where(inside, -np.inf, best)))
            inside[k], self.parent[k] = True, near[k]
            closer = shared[k] > best
            near[closer & ~inside], best = k, np.where(closer & ~inside, shared[k], best)
        for i, p in enumerate(self.parent.tolist()):
            j = i if p < 0 else p
            for u in (0, 1):
                joint = rates[:, :, u, i, j] if p >= 0 else rates[:, :, :, i, i].sum(axis=2)
                self.table[:, i, u] = joint[:, 1] / joint.sum(axis=1)

    def log_joint(self, votes: np.ndarray) -> np.ndarray:
        """log P(votes, class) for each row and class."""
        votes = votes.astype(int)
        up = np.where(self.parent >= 0, votes[:, self.parent], 0)
        chance = self.table[:, np.arange(votes.shape[1]), up]
        chance = np.where(votes[None] == 1, chance, 1 - chance)
        return (np.log(chance).sum(axis=2) + np.log([1 - self.prior, self.prior])[:, None]).T

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = self.log_joint(votes)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -30, 30)))


def chosen_features(rows: Taught, least_ratio: float, least_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features that are rare in other rows, the strongest first, and their log ratios."""
    size, n = len(rows.ids), max(1, rows.label.sum())
    toxic, rest = (np.bincount(rows.col[rows.label[rows.row] == k], minlength=size) for k in (True, False))
    ratio = np.log((toxic + 0.3) / (n + 1)) - np.log((rest + 0.3) / ((~rows.label).sum() + 1))
    able = np.flatnonzero((toxic >= max(LEAST_ROWS, least_share * n)) & (ratio >= least_ratio))
    return able[np.lexsort((able, -(ratio * np.sqrt(toxic))[able]))], ratio


def induced(rows: Taught, able: np.ndarray) -> list[int]:
    """Features that, one after the other, cover most toxic rows that no voter covers twice yet."""
    need = np.where(rows.label, 2 - np.minimum(2, rows.votes.sum(axis=1)), 0).astype(float)
    of = {f: rows.row[rows.col == f] for f in able[:400].tolist()}
    out: list[int] = []
    while len(out) < INDUCED and of:
        gain = {f: need[r].clip(0, 1).sum() for f, r in of.items()}
        best = max(gain, key=lambda f: (gain[f], -f))
        if gain[best] < LEAST_ROWS:
            break
        need[of.pop(best)] -= 1
        need = np.maximum(need, 0)
        out.append(best)
    return out


def fit(rows: Taught, least_ratio: float, least_share: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Numbers of features, their weights, and the bias."""
    able, _ = chosen_features(rows, least_ratio, least_share)
    if not len(able):
        return None
    more = induced(rows, able)
    votes = np.column_stack([rows.votes, np.zeros((len(rows.label), len(more)), dtype=bool)])
    for k, f in enumerate(more):
        votes[rows.row[rows.col == f], FIXED + k] = True
    votes = votes[:, votes.any(axis=0)]
    model = LabelModel(votes)
    model.maximise(rows.label.astype(float))
    post = model.posterior(votes)
    place = np.full(len(rows.ids), -1)
    place[able] = np.arange(len(able))
    keep = place[rows.col] >= 0
    col, row, n = place[rows.col[keep]], rows.row[keep], len(rows.label)
    weight, bias = np.zeros(len(able)), -2.0
    speed, speed_bias = np.full(len(able), 1e-8), 1e-8
    for _ in range(STEPS):
        z = bias + np.bincount(row, weights=weight[col], minlength=n)
        miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - post
        slope = np.bincount(col, weights=miss[row], minlength=len(able)) / n + RIDGE * weight
        speed, speed_bias = speed + slope**2, speed_bias + miss.mean() ** 2
        weight -= 0.5 * slope / np.sqrt(speed)
        bias -= 0.5 * miss.mean() / np.sqrt(speed_bias)
    return able, weight, float(bias)


def predicted(rows: Taught, model: tuple[np.ndarray, np.ndarray, float] | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(rows.label), dtype=bool)
    weight = np.zeros(len(rows.ids))
    weight[model[0]] = model[1]
    return model[2] + np.bincount(rows.row, weights=weight[rows.col], minlength=len(rows.label)) >= 0


def learn(rows: Taught | None) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Feature ids, their weights, and the bias, by the choice that errs least on training rows left out in turn."""
    if rows is None:
        return None
    errors = []
    for choice in CHOICES:
        wrong = np.zeros(2)
        for k in range(FOLDS):
            test = rows.only(rows.fold == k)
            got = predicted(test, fit(rows.only(rows.fold != k), *choice))
            wrong += [(~got[test.label]).sum(), got[~test.label].sum()]
        errors.append(wrong[0] / max(1, rows.label.sum()) + wrong[1] / max(1, (~rows.label).sum()))
    model = fit(rows, *CHOICES[int(np.argmin(errors))])
    return model and (rows.ids[model[0]], model[1], model[2])


def with_score(spark: SparkSession, docs: DataFrame, labels: DataFrame, name: str = "score", id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows and columns of docs, and the score of each whole text under a name that docs doesn't have."""
    model = learn(teach(spark, docs, labels, id_col, text_col, label_col))

    def run(batches):
        kept, weights = np.zeros(BUCKETS, dtype=bool), {}
        if model:
            kept[model[0]] = True
            weights = dict(zip(model[0].tolist(), model[1].tolist()))
        features = Features(kept)
        for batch, texts in pieces(batches, text_col):
            z = np.array([sum(map(weights.__getitem__, features(t)[0])) for t in texts], dtype=float) if model else np.zeros(len(texts))
            p = 1 / (1 + np.exp(-np.clip(z + model[2], -30, 30))) if model else z
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, held_out, score, predicted of each whole text."""
    out = with_score(spark, docs.select(id_col, text_col), labels, "score", id_col, text_col, label_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to be toxic, with the same columns, whatever their names; nulls and empty
    texts, repeated rows and an empty table are kept as they are."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(spark, docs, labels, name).where(F.col(name) < 0.5).drop(name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
