"""Arrow batches of whole texts, in pieces of bounded size."""

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Characters of text that one piece holds, but for a single longer text.
PIECE_CHARS = 4_000_000


def pieces(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches, and their texts with "" for null."""
    for batch in batches:
        texts, start, held = batch.column(text_col), 0, 0
        sizes = [len(t) if t else 0 for t in texts.to_pylist()] if batch.num_rows else []
        for k, n in enumerate(sizes):
            if held and held + n > PIECE_CHARS:
                yield batch.slice(start, k - start), [t or "" for t in texts.slice(start, k - start).to_pylist()]
                start, held = k, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start), [t or "" for t in texts.slice(start).to_pylist()]


def per_process(make: Callable) -> Callable:
    """make(*args), once for each worker process and arguments."""
    made: dict = {}

    def get(*args):
        if args not in made:
            made.clear()
            made[args] = make(*args)
        return made[args]

    return get


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, or the path itself."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
