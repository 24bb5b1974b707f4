"""Byte-level BPE ids through the tokenizers library, with a bounded cache of chunks of text.

The pre-tokenizer of this vocabulary always cuts before a single space, on both sides of a line feed that stand between
other characters, and between a letter and a mark after it, and BPE never crosses such a cut. A text may therefore be
encoded chunk by chunk. Arrow cuts a batch of texts into chunks and numbers the distinct ones, so that Python looks up
each chunk once for a batch, and the library encodes it once for a worker, many new ones as one text. A text with other
white space than that, or with the string of a special token, is encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that chunks don't describe: runs with a space in them, three line feeds or two at the end, and other kinds.
WHOLE = r"  | \n|\n |\n\n\n|\n\n\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x00]"
MARKED = "([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([,.;:!?])"  # a cut: letters of every version of Unicode, and a mark
LATIN = "\u0250"
_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Chunks(dict):
    """Chunk to its number; a chunk that is asked for the first time gets the next one and is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = n = len(self)
        return n


class Encoder:
    def __init__(self, path: str, most_chunks: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most = most_chunks
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = "|".join([WHOLE, *special])
        vocab = self.tok.get_vocab()
        self.feed = self._raw(["\n"])[0][0]
        # byte-level BPE writes a space so, and no merge puts one behind a letter (but behind a no-break space, Âł)
        self.opens = np.zeros(self.tok.get_vocab_size(), bool)
        self.opens[[n for t, n in vocab.items() if t.startswith("Ġ")]] = True
        self.parted = not any("Ġ" in t.lstrip("Ġ") and t.strip("ĠÂł") for t in vocab)
        by_byte = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        rest = [b for b in range(256) if b not in by_byte]
        self.letters = by_byte | {b: chr(256 + n) for n, b in enumerate(rest)}  # its letter for each byte
        self._clear()

    def _clear(self) -> None:
        self.known = Chunks()
        self.flat = np.empty(1 << 16, np.uint32)  # the chunks' ids one after the other
        self.at = np.zeros(1 << 12, np.int32)  # where each chunk's begin, and the last one's end
        self.used = self.done = 0
        # a chunk may be empty, or a line feed
        self.known[""], self.known["\n"] = 0, 1
        self.flat[0], self.at[:3], self.used, self.done = self.feed, (0, 0, 1), 1, 2

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> np.ndarray:
        """Ids of words with a space before each, which are letters only and therefore need no cutting: no merge crosses a space."""
        return np.array([t.id for t in self.tok.model.tokenize(text.encode().decode("latin-1").translate(self.letters))], np.uint32)

    def _learn(self) -> None:
        """Encode the new chunks, in runs: words after a space, other chunks after one, and the rest with line feeds between."""
        new, self.known.new = self.known.new, []
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            kind = np.fromiter(((2 if c[:1] != " " else 0 if self.parted and c[1:].isalpha() and max(c) < LATIN else 1) for c in part), np.int8, len(part))
            runs, sizes = [], np.zeros(len(part), np.int32)
            for j in range(3):
                own = [c for c, x in zip(part, kind.tolist()) if x == j]
                if not own:
                    continue
                if j < 2:
                    ids = self._words("".join(own)) if j == 0 else np.array(self._raw(["".join(own)])[0], np.uint32)
                    sizes[kind == j] = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
                else:
                    ids = np.array(self._raw(["\n".join(["", *own, ""])])[0], np.uint32)
                    feeds = np.flatnonzero(ids == self.feed)
                    sizes[kind == j] = np.diff(feeds) - 1
                    ids = np.delete(ids, feeds)
                runs.append(ids)
            order = np.argsort(kind, kind="stable")  # where each chunk's ids are in the runs, then as listed
            starts = np.empty(len(part), np.int64)
            starts[order] = np.cumsum(sizes[order]) - sizes[order]
            ends = np.cumsum(sizes)
            ids = np.concatenate(runs)[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
            first, total = self.done, self.used + len(ids)
            if total > len(self.flat):
                self.flat = np.resize(self.flat, max(total, 2 * len(self.flat)))
            if first + len(part) >= len(self.at):
                self.at = np.resize(self.at, max(first + len(part) + 1, 2 * len(self.at)))
            self.flat[self.used : total] = ids
            self.at[first + 1 : first + len(part) + 1] = self.used + ends
            self.used, self.done = total, first + len(part)

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (uint32), and the number of ids of each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.known) > self.most:
            self._clear()
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False))
        plain = texts
        if len(whole):
            mask = np.ones(len(texts), bool)
            mask[whole] = False
            plain = pc.if_else(pa.array(mask), texts, "")
        for found, by in ((MARKED, "\\1\0\\2"), ("\n", "\0\n\0"), (" ", "\0 ")):
            plain = (pc.replace_substring_regex if found is MARKED else pc.replace_substring)(plain, found, by)
        cut = pc.split_pattern(plain, "\0")
        numbered = cut.flatten().dictionary_encode()
        own = np.fromiter(map(self.known.__getitem__, numbered.dictionary.to_numpy(zero_copy_only=False)), np.int32, len(numbered.dictionary))
        if self.known.new:
            self._learn()
        every = pa.ListArray.from_arrays(pa.array(self.at[: self.done + 1]), pa.array(self.flat[: self.used]))
        found = every.take(pa.array(own[numbered.indices.to_numpy()]))
        ids, ends = found.flatten().to_numpy(), found.offsets.to_numpy()
        bounds = ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()].astype(np.int64)
        if not len(whole):
            return ids, np.diff(bounds)
        raw = dict(zip(whole.tolist(), self._raw(texts.take(pa.array(whole)).to_pylist())))
        parts = [np.asarray(raw[k], np.uint32) if k in raw else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
