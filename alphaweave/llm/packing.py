"""Packing documents into token windows by best-fit decreasing.

`token_pieces` turns every document into the ids of a public tokenizer plus an end id and cuts overlong ones into full
windows and a rest. `pack` deals the pieces into groups of bounded size and fills windows group by group: pieces in
falling length, each into the open window with the least room that still holds it, found in a segment tree over the
remaining capacity. Groups are independent, so nothing larger than a group meets in one task; each leaves at most a few
windows half full.

Defined results: null and empty texts are the end id alone. Repeated rows are pieces of their own. An empty table gives
no pieces. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import ctypes
import gc
import os
import string
import sys
import threading
import types
from array import array
from contextlib import contextmanager, suppress
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 2048
END_ID = 1
GROUP_PIECES = 4096
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text tokenized at once; words a worker remembers, some 300 bytes each; ids per batch of pieces.
BATCH_BYTES, CACHE_WORDS, PIECE_IDS = 1 << 20, 700_000, 1 << 22
#: Seconds for which a worker remembers them after a task.
KEPT_SECONDS = 20
#: Stands between parts of words that are tokenized in one call.
SEPARATOR, AT_ONCE = "~", 1000


class WordIds:
    """Ids of white-space-separated words, each part tokenized once while remembered.

    The tokenizer drops white space, lowers case and splits letters from signs, and joins nothing across those places,
    so the ids of a text are those of its words, and those of a word are its stem's and its closing signs'.
    """

    def __init__(self, path: str, remember: int | None = None):
        # A task has one core; the tokenizer's own threads would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        (self.separator,) = self.encode([SEPARATOR], add_special_tokens=False)[0].ids
        self.remember = CACHE_WORDS if remember is None else remember
        self.stems: dict[str, int] = {"": 0}
        self.flat, self.starts, self.lengths = array("I"), array("q", [0]), array("q", [0])
        self.index: dict[bytes, int] = {}
        self.parts_of = array("i")  # two stems a word; the second one may be empty

    def forget(self) -> None:
        """Half the words, those learned first, stay with their stems: common ones are met early, most later ones but once."""
        self.index = dict(islice(self.index.items(), self.remember // 2))
        self.parts_of = self.parts_of[: 2 * len(self.index)]
        n = max(self.parts_of, default=0) + 1
        self.stems = dict(islice(self.stems.items(), n))
        self.starts, self.lengths = self.starts[:n], self.lengths[:n]
        self.flat = self.flat[: self.starts[-1] + self.lengths[-1]]

    @staticmethod
    def parts(word: bytes) -> tuple[str, str]:
        if word.isalpha():  # ASCII letters alone
            return word.lower().decode(), ""
        text = word.decode()
        if "<|" in text:  # may hold a special token, which case decides
            return text, ""
        stem = text.rstrip(string.punctuation)
        if stem and stem != text and (stem[-1] < "\u0250" and stem[-1].isalpha()):
            return word[: len(stem.encode())].lower().decode(), text[len(stem) :]
        return word.lower().decode(), ""

    def encoded(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stems and the number of each's; many at once, told apart by the separator's id. An encoding takes some 150 bytes an id, so one is held at a time."""
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(stems), AT_ONCE):
            call = stems[i : i + AT_ONCE]
            (found,) = self.encode([f" {SEPARATOR} ".join(call)], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(ids == self.separator)
            if len(ends) == len(call) - 1:
                parts.append(np.delete(ids, ends))
                sizes.append(np.diff(np.r_[-1, ends, len(ids)]) - 1)
            else:  # a stem holds the separator
                each = [e.ids for e in self.encode(call, add_special_tokens=False)]
                parts += [np.array(x, np.uint32) for x in each]
                sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(parts), np.concatenate(sizes)

    def learn(self, words: list[bytes]) -> None:
        parts = [self.parts(w) for w in words]
        stems = list({p for x in parts for p in x if p not in self.stems})
        ids, sizes = self.encoded(stems)
        self.stems.update(zip(stems, range(len(self.starts), len(self.starts) + len(stems))))
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).tobytes())
        self.lengths.frombytes(sizes.tobytes())
        self.flat.frombytes(ids.tobytes())
        self.parts_of.extend([self.stems[p] for x in parts for p in x])
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the number of ids of each."""
        if len(self.index) > self.remember:
            self.forget()
        split = [t.encode().split() for t in texts]
        words = [w for x in split for w in x]
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if len(unknown := np.flatnonzero(at < 0)):
            missing = [words[i] for i in unknown.tolist()]
            self.learn(list(dict.fromkeys(missing)))
            at[unknown] = [self.index[w] for w in missing]
        stems = np.frombuffer(self.parts_of, np.int32).reshape(-1, 2)[at].reshape(-1)
        lengths = np.frombuffer(self.lengths, np.int64)[stems]
        ends = np.cumsum(lengths)
        shift = np.frombuffer(self.starts, np.int64)[stems] - ends + lengths
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.r_[0, ends][2 * np.cumsum([0, *map(len, split)])]
        return ids, np.diff(upto)


def _forget(kept: dict, path: str) -> None:
    """Drop what is kept and give its memory back to the system."""
    kept.pop(path, None)
    gc.collect()
    with suppress(AttributeError, OSError, TypeError):  # glibc holds on to what the tokenizer has freed
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def worker_word_ids(path: str, remember: int):
    """What the worker process has learned, kept for a task that soon follows. After that its memory goes back, as tasks of
    other stages run in the same process."""
    kept = sys.modules.setdefault("_kept_word_ids", types.ModuleType("_kept_word_ids")).__dict__
    word_ids, timer = kept.pop(path, (None, None))
    if timer:
        timer.cancel()
    word_ids = word_ids or WordIds(path)
    word_ids.remember = remember
    try:
        yield word_ids
    finally:
        timer = threading.Timer(KEPT_SECONDS, _forget, (kept, path))
        timer.daemon = True
        kept[path] = word_ids, timer
        timer.start()


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, remember: int = CACHE_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens and its ids as little-endian unsigned 32-bit numbers."""
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def cut(batches):
        def pieces(word_ids, keys, texts):
            ids, sizes = word_ids(texts)
            # Every text's end id goes behind its last one; the pieces then follow each other in one array.
            ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
            sizes = sizes + 1
            count = -(-sizes // window)
            doc = np.repeat(np.arange(len(sizes)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * window
            length = np.minimum(window, sizes[doc] - start)
            ends = np.r_[0, np.cumsum(length)]
            per = max(1, PIECE_IDS // window)
            for lo in range(0, len(doc), per):
                part = slice(lo, lo + per)
                base, offsets = ends[lo], ends[lo : lo + per + 1]
                data = [None, pa.py_buffer(((offsets - base) * 4).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids[base : offsets[-1]]))]
                columns = [pa.array(keys, pa.int64()).take(pa.array(doc[part])), *(pa.array(x[part]) for x in (start, length, sizes[doc]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.Array.from_buffers(pa.binary(), len(offsets) - 1, data)], names)

        with worker_word_ids(tokenizer_path, remember) as word_ids:
            keys, texts, size = [], [], 0
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py() or ""
                    keys.append(key)
                    texts.append(text)
                    size += len(text)
                    if size > BATCH_BYTES:
                        yield from pieces(word_ids, keys, texts)
                        keys, texts, size = [], [], 0
            if keys:
                yield from pieces(word_ids, keys, texts)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece, given in falling length."""
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)  # open windows below each node, by remaining capacity
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def count(room: int, by: int) -> None:
        i = room + leaves
        while i:
            tree[i] += by
            i >>= 1

    def tightest(need: int) -> int:
        """The least remaining capacity >= need of an open window; -1 if there is none."""
        i = need + leaves
        while not tree[i]:
            while i & 1:  # a right child: its parent's range ends here too
                i >>= 1
            if not i:
                return -1
            i += 1
            if i & (i - 1) == 0:
                return -1
        while i < leaves:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        return i - leaves

    window, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, need in enumerate(lengths.tolist()):
        room = tightest(need)
        if room < 0:
            w, room, n = n, capacity, n + 1
        else:
            w = open_at[room].pop()
            count(room, -1)
        window[k], offset[k] = w, capacity - room
        if room > need:
            open_at[room - need].append(w)
            count(room - need, 1)
    return window, offset


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset; they need a `length` column and must not be computed anew between uses."""
    groups = max(1, -(-pieces.count() // group_pieces))
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset", "piece")]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)

    def fill(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "piece"], ascending=[False, True], kind="stable")
        w, offset = best_fit(group["length"].to_numpy(), window)
        return group[columns].assign(sequence_id=(key[0] << 32) + w, offset=offset)

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, remember: int = CACHE_WORDS) -> DataFrame:
    """Every piece with the crc32 of its ids and its place. Workers remember so many words: fewer take less memory and more time."""
    pieces = token_pieces(docs, tokenizer_path, window, remember=remember).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", F.monotonically_increasing_id().alias("piece"))
    return pack(stored(pieces), window)
