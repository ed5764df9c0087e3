"""Token counts by a two-tier lookup on the map side: frequent pre-tokens from a broadcast table, the rest through worker caches; nothing is shuffled."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, utf8

#: Pre-tokens that a worker remembers beside the broadcast table.
REMEMBERED = 1_000_000
#: Bytes above which a pre-token is encoded each time it occurs.
LONGEST = 64

#: Of this process, which runs many tasks: tokenizers by path, and lengths of pre-tokens by path.
_loaded: dict[str, object] = {}
_met: dict[str, dict[bytes, int]] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _loaded[path] = tok
    return _loaded[path]


def _length(path: str, word: bytes) -> int:
    return len(_tokenizer(path).encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)


def remembered(path: str) -> dict[bytes, int]:
    """This process's lengths of pre-tokens. A task's function must get them by a call: globals that it names itself are sent along as copies."""
    return _met.setdefault(path, {})


def frequent(path: str) -> dict[bytes, int]:
    """Token counts of the frequent pre-tokens: the whole words among the vocabulary's entries.

    The vocabulary holds what was frequent when it was made, so the table is as large as it (49,000 entries at most here) and needs no pass over
    the documents. The lengths are the library's. The table bears on speed alone.
    """
    end = "</w>"
    words = sorted(w[: -len(end)] for w in _tokenizer(path).get_vocab() if w.endswith(end) and len(w) > len(end) and w.isascii())
    encoded = [w.encode() for w in words]
    return {w: _length(path, w) for w in encoded if w.split() == [w] and len(w) <= LONGEST}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Adds n_bytes, n_tokens, over_limit to the docs' other columns, without the text.

    The tokenizer drops white space and no token crosses it, so a text has the tokens of its words between ASCII white space; each
    such word goes whole through the library once a worker (special strings in it as the library handles them). Null and empty
    texts have no tokens. Other columns pass through; columns named as the three new ones are replaced. Repeated rows are
    documents of their own, and an empty table gives an empty one. A very long text is counted word by word.
    """
    path = path or vocabulary()
    table = docs.sparkSession.sparkContext.broadcast(frequent(path))
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != "text"]
    schema = docs.select(*kept).withColumns({"n_bytes": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long"), "over_limit": F.lit(True)}).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = table.value, remembered(path)
        for batch, texts in blocks(batches):
            totals = []
            for x in texts:
                words = x.split()
                lengths = list(map(known.get, words))
                total = 0
                if None in lengths:
                    for i, n in enumerate(lengths):
                        if n is None:
                            w = words[i]
                            n = own.get(w)
                            if n is None:
                                n = _length(path, w)
                                if len(w) <= LONGEST:
                                    if len(own) >= REMEMBERED:
                                        own.clear()
                                    own[w] = n
                            total += n
                        else:
                            total += n
                else:
                    total = sum(lengths)
                totals.append(total)
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(map(len, texts), pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())],
                names=[*kept, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(*kept, utf8().alias("text")).mapInArrow(count, schema)
