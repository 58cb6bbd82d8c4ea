"""Packing: order-preserving dynamic programming over cuts at document and sentence boundaries.

The tokens of a task's documents, in stored order, form one line. Windows of at most ``width`` tokens cover it; a
window costs its padding plus the penalty of the cut that ends it (none at a document's end, some at a sentence's end,
more elsewhere). With f the least cost up to a cut and t its place, f(j) = width - t(j) + penalty(j) + min (f(i) + t(i))
over the cuts i within reach, and a monotone queue keeps that minimum. Windows whose length is a power of two are not
padded; the few cuts at such a distance are tried beside the queue, everywhere in the line.

A line is solved in stretches of ``STRETCH`` tokens; the last window of a stretch is opened again in the next one, so
memory does not grow with the input. No rows are shuffled.

Defined cases: null and empty texts are the closing id alone; a document longer than a window is cut, and a text of any
length is encoded whole; repeated rows are packed each, so their sequences tell them apart; of equally good cuts the one
that the program meets first stands; extra columns don't matter, whatever their names; an empty table gives no rows.
"""

import base64
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.batches import per_process, pieces, tokenizer_path

STRETCH = 262_144
#: Penalties in tokens, for a cut at a sentence's end, at another place, and for a window shorter than the width.
AT_SENTENCE, INSIDE, SHORT = 1.0, 8.0, 6.0
#: Longest stretch without a boundary, and the distance of the cuts put into a longer one.
GAP, STEP = 32, 16


class Encoder:
    """Ids of a byte-level tokenizer, and where sentences end.

    The tokenizer's vocabulary as ranks gives the same ids faster; texts that hold a special string, and those whose
    runs of blanks are too long for its pattern, go through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        size = self.tokenizer.get_vocab_size()
        self.breaks, self.ends, self.spaced = (np.zeros(size, dtype=bool) for _ in range(3))
        for token, i in table.items():
            self.breaks[i], self.ends[i], self.spaced[i] = b"\n" in token, token[-1:] in b".!?", token[:1] in b" \n\t\r"

    def line(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and the places after which a sentence or a line ends."""
        ids = None
        if not any(x in text for x in self.special):
            try:
                ids = self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern's stack is bounded
                pass
        if ids is None:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if not len(ids):
            return ids, np.zeros(0, dtype=np.int64)
        return ids, np.flatnonzero(self.breaks[ids] | self.ends[ids] & np.r_[self.spaced[ids[1:]], True]) + 1


def power_steps(places: np.ndarray, width: int) -> list[list[int]]:
    """For each place the indices of places before it at a distance that is a power of two below width."""
    at = np.full(int(places[-1]) + 1, -1, dtype=np.int64)
    at[places] = np.arange(len(places))
    out: list[list[int]] = [[]] * len(places)
    for length in (1 << k for k in range(width.bit_length()) if 1 << k < width):
        begins = at[np.maximum(places - length, 0)]
        hit = np.flatnonzero((begins >= 0) & (places >= length))
        for j, i in zip(hit.tolist(), begins[hit].tolist()):
            out[j] = [*out[j], i]
    return out


def best_cuts(places: list[int], penalty: list[float], width: int) -> list[int]:
    """Indices of the chosen places, the first (0) and the last included; neighbours are at most width apart."""
    cost, back = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # rising values of cost + place
    steps = power_steps(np.array(places), width)
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0][1]] < p - width:
            queue.popleft()
        value, i = queue[0]
        least = value + width - p
        for k in steps[j]:
            if cost[k] + SHORT < least:
                least, i = cost[k] + SHORT, k
        cost[j], back[j] = least + penalty[j], i
        value = cost[j] + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chosen = [len(places) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


class Line:
    """The open stretch of one task."""

    def __init__(self, width: int, first_sequence: int):
        self.width, self.sequence = width, first_sequence
        self.docs: list[tuple] = []  # id, ids, sentence ends, where the ids start in the document, tokens of the document
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_id, ids, ends, 0, len(ids)))
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are settled; the rest stays, unless this is the last call."""
        if not self.docs:
            return []
        begins = np.cumsum([0, *(len(d[1]) for d in self.docs)])
        inner = [d[2] + b for d, b in zip(self.docs, begins)]
        places = np.unique(np.concatenate([begins, *inner]))
        places = places[places <= begins[-1]]
        gaps = np.flatnonzero(np.diff(places) > GAP)
        filled = [np.arange(places[k] + STEP, places[k + 1], STEP) for k in gaps]
        penalty = dict.fromkeys(np.concatenate(filled).tolist(), INSIDE) if filled else {}
        places = np.union1d(places, np.concatenate(filled)) if filled else places
        penalty |= dict.fromkeys(begins.tolist(), 0.0)
        places = places.tolist()
        cuts = [places[k] for k in best_cuts(places, [penalty.get(p, AT_SENTENCE) for p in places], self.width)]
        if not last:
            cuts.pop()
        out, k, starts = [], 0, begins.tolist()
        for a, b in zip(cuts, cuts[1:]):
            at = a
            while at < b:
                while starts[k + 1] <= at:
                    k += 1
                doc_id, ids, _, begin, whole = self.docs[k]
                to = min(b, starts[k + 1])
                piece = ids[at - starts[k] : to - starts[k]]
                out.append((doc_id, begin + at - starts[k], to - at, zlib.crc32(piece.tobytes()), whole, self.sequence, at - a))
                at = to
            self.sequence += 1
        end = cuts[-1]
        rest = []
        if not last:
            for (doc_id, ids, ends, begin, whole), s in zip(self.docs, starts):
                if s + len(ids) > end:
                    skip = max(0, end - s)
                    rest.append((doc_id, ids[skip:], ends[ends > skip] - skip, begin + skip, whole))
        self.docs, self.held = rest, sum(len(d[1]) for d in rest)
        return out


encoder = per_process(lambda name, ranks: Encoder(tokenizer_path(name), tokenizer_path(ranks)))


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", width: int = 1024, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches):
        line = Line(width, TaskContext.get().partitionId() << 40)
        end = np.array([closing], dtype=np.uint32)
        key_type, encode = None, encoder(tokenizer, ranks).line

        def rows(found):
            if not found:
                return
            cols = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch, texts in pieces(batches, text_col):
            key_type = batch.schema.field(id_col).type
            for doc_id, text in zip(batch.column(id_col).to_pylist(), texts):
                ids, ends = encode(text)
                line.add(doc_id, np.concatenate([ids, end]), ends)
                if line.held >= STRETCH:
                    yield from rows(line.flush(False))
        yield from rows(line.flush(True))

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op4_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
