"""Token counts by rank-synchronous merging of ragged arrays.

A piece vocabulary never joins a word to the space mark that follows it, so a text falls into pre-tokens that merge
independently: a mark with what follows it, and a line break with what follows it. Distinct pre-tokens are laid out as
one ragged array of symbols. In each step every sequence finds its pair of lowest rank and merges all its occurrences
at once, from the left where they overlap; where a merge could create a pair of lower rank still, only the leftmost
one. What survives is counted; a character outside the vocabulary counts its UTF-8 bytes.

Defined cases: null and empty texts have no tokens; repeated rows and extra columns don't matter; texts have any length.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.batches import per_process, pieces, tokenizer_path

MARK = "▁"
#: Pre-tokens whose counts a worker remembers.
MEMO = 300_000
NONE = np.iinfo(np.int64).max


class PieceCounter:
    """Counts of a sentencepiece BPE model with byte fallback and no normalisation but the space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = [model.id_to_piece(i) for i in normal]
        if model.normalize(" Ⅻ  a") != MARK * 2 + "Ⅻ" + MARK * 2 + "a":
            raise ValueError("this model normalises its input")
        if any(MARK in x.lstrip(MARK) or "\n" in x for x in names):
            raise ValueError("this model's pieces cross pre-tokens")
        rank = {x: k for k, x in enumerate(sorted(names, key=lambda x, s=dict(zip(names, map(model.get_score, normal))): -s[x]))}
        self.ids = dict(rank)
        for x in names:
            for c in x:
                self.ids.setdefault(c, len(self.ids))
        self.n = len(self.ids) + 5  # then four ids for unknown characters of 1 to 4 bytes
        keys, to = [], []
        for x in names:
            for k in range(1, len(x)):
                if x[:k] in self.ids and x[k:] in self.ids:
                    keys.append(self.ids[x[:k]] * self.n + self.ids[x[k:]])
                    to.append(rank[x])
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.to = np.array(keys, dtype=np.int64)[order], np.array(to, dtype=np.int64)[order]
        # a merge into x is safe to do everywhere at once if no pair with x has a lower rank than x
        lowest = np.full(self.n, NONE)
        np.minimum.at(lowest, self.keys // self.n, self.to)
        np.minimum.at(lowest, self.keys % self.n, self.to)
        self.safe = lowest >= np.arange(self.n)
        self.cost = np.ones(self.n, dtype=np.int64)
        for c, i in self.ids.items():
            if i >= len(rank):
                self.cost[i] = len(c.encode())
        for b in range(1, 5):
            self.cost[len(self.ids) + b] = b
        self.after_mark: dict[str, int] = {}
        self.plain: dict[str, int] = {}

    def symbol(self, c: str) -> int:
        i = self.ids.get(c)
        return len(self.ids) + len(c.encode("utf-8", "surrogatepass")) if i is None else i

    def merged(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word."""
        out = np.zeros(len(words), dtype=np.int64)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        own = np.repeat(np.arange(len(words)), lens)
        known = {c: self.symbol(c) for c in set("".join(words))}
        s = np.fromiter(map(known.__getitem__, "".join(words)), dtype=np.int64, count=int(lens.sum()))
        while len(s):
            rank = np.full(len(s), NONE)
            pair = s[:-1] * self.n + s[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = (self.keys[at] == pair) & (own[:-1] == own[1:])
            rank[:-1][hit] = self.to[at[hit]]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.r_[heads, len(s)]))
            over = best == NONE
            if over.any():
                out += np.bincount(own[over], weights=self.cost[s[over]], minlength=len(words)).astype(np.int64)
            there = np.flatnonzero((rank == best) & ~over)
            first = np.r_[True, own[there][1:] != own[there][:-1]] if len(there) else np.zeros(0, dtype=bool)
            run = np.r_[True, np.diff(there) != 1] | first if len(there) else first
            since = np.arange(len(there)) - np.maximum.accumulate(np.where(run, np.arange(len(there)), 0))
            there = there[np.where(self.safe[rank[there]], since % 2 == 0, first)]
            s[there] = rank[there]
            keep = ~over
            keep[there + 1] = False
            s, own = s[keep], own[keep]
        return out

    def learn(self, memo: dict[str, int], words: set[str], mark: str) -> None:
        new = list(words.difference(memo))
        if new:
            memo.update(zip(new, self.merged([mark + w for w in new]).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        lines, odd = [], []
        marked, plain = set(), set()
        for text in texts:
            if MARK in text:
                text = text.replace(MARK, " ")
            if not text or "  " in text or text[0] == " ":
                # runs of spaces: marks that stand together merge with each other
                odd.append(re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*", MARK + text.replace(" ", MARK)) if text else [])
                lines.append(None)
                continue
            rows = [x.split(" ") for x in text.split("\n")]
            lines.append(rows)
            for k, row in enumerate(rows):
                if k:
                    plain.add(row[0])
                    marked.update(row[1:])
                else:
                    marked.update(row)
        if len(self.after_mark) + len(self.plain) > MEMO:
            self.after_mark.clear()
            self.plain.clear()
        self.learn(self.after_mark, marked, MARK)
        self.learn(self.plain, plain, "\n")
        spread = self.merged([w for ws in odd for w in ws])
        ends = np.cumsum([0, *map(len, odd)])
        sums = np.r_[0, np.cumsum(spread)]
        slow = iter((sums[ends[1:]] - sums[ends[:-1]]).tolist())
        a, b = self.after_mark.__getitem__, self.plain.__getitem__
        return [next(slow) if rows is None else sum(sum(map(a, row[1:])) + b(row[0]) if k else sum(map(a, row)) for k, row in enumerate(rows)) for rows in lines]


counter = per_process(lambda name: PieceCounter(tokenizer_path(name)))


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of each whole text; model: a name of a public tokenizer, or a path."""

    def run(batches):
        count = counter(model).counts
        for batch, texts in pieces(batches, text_col):
            n = pa.array(count(texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), n, pa.array([x > limit for x in n.to_pylist()], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
