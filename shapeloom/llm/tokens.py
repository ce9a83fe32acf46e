"""Tokenizers and flat token files in the shared folder."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOD = 50256  # free in that vocabulary of ranks
DTYPE = np.dtype("<u2")

#: Fixed value: how that vocabulary's texts are cut into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _load(path: str):
    """Function from a list of texts to a list of id sequences, for any of the three kinds of vocabulary files; and the number of ids."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        t = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: [t.encode_ordinary(x) for x in texts]), max(ranks.values()) + 1
    if path.endswith(".model"):
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: t.encode(texts, num_threads=1)), t.vocab_size()
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # a text that spells a special token is ordinary text
    return (lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]), t.get_vocab_size()


WIDE = np.dtype("<u4")  # for vocabularies of more than 65,536 ids


def encode(texts: list[str], path: str = TOKENIZER, dtype: np.dtype = DTYPE) -> list[np.ndarray]:
    """Token ids of whole texts.  Texts go in batches of about a megabyte."""
    (run, ids_), out, batch, size = _load(path), [], [], 0
    if ids_ - 1 > np.iinfo(dtype).max:
        raise ValueError(f"{path} has {ids_} ids, too many for {dtype}")
    for x in texts:
        batch.append(x)
        size += len(x)
        if size > 1 << 20:
            out += [np.array(ids, dtype) for ids in run(batch)]
            batch, size = [], 0
    if batch:
        out += [np.array(ids, dtype) for ids in run(batch)]
    return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI that all executors reach."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


class Writer:
    """Writes beside the final name and moves there on close, so a lost or repeated task leaves no torn file."""

    def __init__(self, folder: str, name: str, attempt: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/{name}", f"{root}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def attempt_mark() -> str:
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{c.stageId()}-{c.partitionId()}-{c.taskAttemptId()}" if c else "local"


def string_list(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
