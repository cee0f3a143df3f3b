"""Encoding of whole texts with a public tokenizer, inside tasks.

A tokenizer that drops white space encodes a text as the concatenation of what it makes of the text's
blank-separated chunks. Where a probe confirms that, each Arrow batch is cut into chunks, equal chunks are
encoded once, and each worker keeps the ids of the stems that most parts had; other tokenizers encode whole
texts. Chunks of texts beyond ASCII go to the library as they are: it composes marks before it lower-cases. The store of
ids is bounded in bytes and affects speed only."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import parts_of

PROBE = "Ab, c\n\n  d-e 'f it's x9 \t ...g É"
#: ASCII punctuation behind an ASCII letter always begins a new piece there (an apostrophe may not).
TAIL = r"([A-Za-z])([.,;:!?|*$%&#])"
#: Bytes of a cache entry beside its characters and ids.
ENTRY = 200
#: Texts that the library encodes at once: what it returns for each is many times its ids.
AT_ONCE = 2048
_loaded: dict[tuple, "ChunkEncoder"] = {}


def gathered(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The concatenation of values[start : start + length] of every run."""
    ends = np.cumsum(lengths, dtype="i8")
    total = int(ends[-1]) if len(ends) else 0
    kind = "i4" if max(total, len(values)) < 1 << 31 else "i8"  # half the memory for what parts of texts have
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


class ChunkEncoder:
    def __init__(self, path: str, end_id: int, cache_bytes: int = 48 << 20, longest: int = 48, part: int = 4 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end, self.cache_bytes, self.longest, self.part = end_id, cache_bytes, longest, part
        # words' slots; of each slot, the end id's first: its ids' start in values, their number, and how many parts had it
        self.cache: dict[str, int] = {}
        self.start, self.size, self.hits, self.values = np.zeros(1, "i8"), np.ones(1, "i8"), np.zeros(1, "i8"), np.array([end_id], "<u4")
        parts = [i for x in PROBE.split() for i in self.library.encode(x, add_special_tokens=False).ids]
        self.by_chunk = self.library.encode(PROBE, add_special_tokens=False).ids == parts
        ascii_only = "".join(c for c in PROBE if c.isascii())
        self.lowers = self.library.encode(ascii_only, add_special_tokens=False).ids == self.library.encode(ascii_only.lower(), add_special_tokens=False).ids

    def raw(self, texts: list[str]) -> list[bytes]:
        groups = (texts[i : i + AT_ONCE] for i in range(0, len(texts), AT_ONCE))
        return [np.asarray(e.ids, "<u4").tobytes() for g in groups for e in self.library.encode_batch_fast(g, add_special_tokens=False)]

    def stems(self, ask: list[str]) -> dict[str, bytes]:
        """Stems of letters go to the library many to a text; its word numbers part them again."""
        out, letters = {}, [s for s in ask if s.isalpha()]
        groups = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        found = (e for i in range(0, len(groups), 16) for e in self.library.encode_batch([" ".join(g) for g in groups[i : i + 16]], add_special_tokens=False))
        for g, e in zip(groups, found, strict=True):
            word = np.asarray(e.word_ids)
            cuts = np.flatnonzero(np.diff(word, prepend=-1))
            if len(cuts) == len(g):
                data, at = np.asarray(e.ids, "<u4").tobytes(), [*(4 * cuts).tolist(), 4 * len(word)]
                out.update((s, data[a:b]) for s, a, b in zip(g, at, at[1:], strict=False))
        rest = [s for s in ask if s not in out]
        out.update(zip(rest, self.raw(rest), strict=True))
        return out

    def slots(self, distinct: list[str]) -> np.ndarray:
        """Where the words' ids are in the store; what it lacks is encoded and added."""
        out = np.fromiter(map(self.cache.get, distinct, repeat(-1)), "i8", len(distinct))
        lacking = np.flatnonzero(out < 0)
        if len(lacking):
            new = [distinct[i] for i in lacking.tolist()]
            ids = self.stems(new)
            found = [ids[s] for s in new]
            size = np.fromiter(map(len, found), "i8", len(found)) // 4
            out[lacking] = len(self.size) + np.arange(len(new))
            self.cache.update((s, i) for s, i in zip(new, out[lacking].tolist(), strict=True) if len(s) <= self.longest)
            self.start = np.concatenate([self.start, len(self.values) + np.cumsum(size) - size])
            self.size, self.hits = np.concatenate([self.size, size]), np.concatenate([self.hits, np.zeros(len(new), "i8")])
            self.values = np.concatenate([self.values, np.frombuffer(b"".join(found), "<u4")])
        self.hits[out] += 1
        return out

    def bounded(self) -> None:
        """A store over its bytes keeps the words that most parts had, of equals the latest, up to half of them."""
        if ENTRY * len(self.size) + 4 * len(self.values) <= self.cache_bytes:
            return
        slots = np.fromiter(self.cache.values(), "i8", len(self.cache))
        slots = slots[np.lexsort((slots, self.hits[slots]))[::-1]]
        kept = np.sort(slots[np.cumsum(ENTRY + 4 * self.size[slots]) <= self.cache_bytes // 2])
        to = np.full(len(self.size), -1)
        to[kept] = 1 + np.arange(len(kept))
        self.cache = {s: i for s, i in zip(self.cache, to[np.fromiter(self.cache.values(), "i8", len(self.cache))].tolist(), strict=True) if i > 0}
        kept = np.insert(kept, 0, 0)  # the end id
        self.values = gathered(self.start[kept], self.size[kept], self.values)
        self.size, self.hits = self.size[kept], self.hits[kept] // 2
        self.start = np.cumsum(self.size) - self.size

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts of bounded size: the first text's place, all ids in order, and how many each text
        has with its end id; null is the empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for at, to in parts_of(texts, self.part):
            part = pa.array(texts.slice(at, to - at).to_pylist(), pa.large_string())  # its own buffers, from offset 0
            special = self.by_chunk and pc.any(pc.match_substring(part, "<|")).as_py()
            yield at, *(self.whole(part) if special or not self.by_chunk else self.cut(part))

    def whole(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Also texts with a special token's own spelling: the library sees them as they are."""
        each = [x + np.uint32(self.end).tobytes() for x in self.raw(part.to_pylist())]
        return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], "i8")

    def cut(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        # without marks it can be lower-cased first: what is left are fewer unlike words
        part = pc.if_else(pc.string_is_ascii(part), pc.ascii_lower(part), part) if self.lowers else part
        apart = pc.replace_substring_regex(part, TAIL, r"\1 \2")
        lists = pc.ascii_split_whitespace(apart)
        coded = lists.flatten().dictionary_encode()
        slots = self.slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype("i8"))
        order = np.insert(slots[coded.indices.to_numpy()], ends, 0)  # the end id behind each text's last chunk
        size = self.size[order]
        ids = gathered(self.start[order], size, self.values)
        last = np.cumsum(size)[ends + np.arange(len(ends))]
        self.bounded()
        return ids, np.diff(last, prepend=0)


def encoder(path: str, end_id: int, **bounds: int) -> ChunkEncoder:
    """One encoder for each Python worker; ``bounds``: cache_bytes and part, where they are not the usual ones."""
    key = (path, end_id, *sorted(bounds.items()))
    if key not in _loaded:
        _loaded[key] = ChunkEncoder(path, end_id, **bounds)
    return _loaded[key]
