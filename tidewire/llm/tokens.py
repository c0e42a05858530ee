"""Whole texts to token ids, by the public tokenizers, at a word's price.

Byte-pair encoders first cut a text into pieces that are encoded one by one.  Two of the
places where they always cut can be found without their pattern, so a text is split
there, each distinct part of a batch is looked up once, and the ids of recent parts are
kept: most words of a corpus are seen again.

* ``word``: the encoder drops white space, hence any ASCII white space parts a text.
* ``byte``: white space starts a word's piece.  Where a text has only single blanks and
  line feeds between its words, each blank belongs to the word behind it and each line
  feed stands alone.  Any other text is encoded as a whole.

A new part of Latin letters alone, with or without marks behind them, is a single piece
and goes to the library's model at once; any other new part goes the library's whole way.
A text that holds the string of an added token, such as ``<|endoftext|>``, is encoded as a
whole, too: the library finds those before it cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Parts whose ids a worker keeps, about 45 bytes each; the half used last stays when they are more.
KEPT = 1_000_000
#: New parts that are encoded in a call, and characters of text that are split at a time.
TOGETHER, AT_ONCE = 1000, 3_000_000
#: White space other than blanks and line feeds, by any definition of it; and the sign of a text's first word.
OTHER_SPACE = "\0\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎               　"
#: Latin letters, which have one form only, and marks behind them, which are never one piece with a letter.
LETTERS, TAILS = "^[A-Za-zÀ-ÖØ-öø-ɏ]+$", ".,!|&%$*#?;:"


def _regular(text: str) -> bool:
    """Single blanks and line feeds between words, and no other white space."""
    if text[:1] in " \n" or text[-1:] in " \n" or "  " in text or any(c in text for c in OTHER_SPACE):
        return False
    return "\n" not in text or not ("\n\n" in text or "\n " in text or " \n" in text)


def _is_word_style(tokenizer) -> bool:
    import json

    rules = json.loads(tokenizer.to_str())
    pre = rules.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed"


def _gather(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` ids from ``first`` on, one after another."""
    end = np.cumsum(n)
    return ids[np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + n, n)]


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 257)], np.uint64)


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    n = np.diff(ends)
    out = np.zeros(len(words), np.uint64)
    if len(words) and ends[-1] > ends[0]:
        raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        start = ends[:-1] - ends[0]
        place = np.arange(len(raw)) - np.repeat(start, n)
        out[n > 0] = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 255], start[n > 0])
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xD6E8FEB86659FD93)


class Encoder:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.word_style = _is_word_style(self.tokenizer)
        letters = ByteLevel(add_prefix_space=False, use_regex=False)  # the library's letters for bytes
        self.letters = {n: letters.pre_tokenize_str(chr(n))[0][0] for n in range(32, 0x250)}
        self.pieces = Tokenizer(self.tokenizer.model)  # of a whole piece a line, in the letters for its bytes
        self.pieces.pre_tokenizer = CharDelimiterSplit("\n")
        names = sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda v: v[1])
        self.lengths = np.zeros(names[-1][1] + 1, np.int64)  # letters that each id stands for
        self.lengths[[i for _, i in names]] = [len(n.removesuffix(self.tokenizer.model.end_of_word_suffix or "")) for n, _ in names]
        self.line_feed = self._flat(["\n"])[0]
        # What is kept: words, where their ids start, how many they are, when they were used last, and the ids.
        self.words = pa.array([], pa.string())
        self.first, self.n, self.used, self.known = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes of the words, in order, and their places
        self.now = 0

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, the library's way, one after another, and how many each has."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)

    def _has_added(self, text: str) -> bool:
        """Whether an added token's string is in the text or could get there, since parts are made lower-case."""
        text = text.lower() if self.word_style and "<" in text else text
        return any(a in text for a in self.added)

    def _parts(self, texts: list[str]) -> pa.ListArray:
        """Words; in ``byte`` style one stands for itself with the blank before it, or is led by a line feed or, at the start, by NUL."""
        if self.word_style:
            return pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.string())))
        return pc.split_pattern(pa.array([f"\0{t}".replace("\n", " \n") for t in texts], pa.string()), " ")

    def _one_piece(self, words: pa.Array, blank: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters, with a blank before each if asked, and how many each has."""
        size = pc.binary_length(words).to_numpy() + blank
        runs = [words[i : i + TOGETHER].to_pylist() for i in range(0, len(words), TOGETHER)]
        lines = [("\n ".join(["", *r])[1:] if blank else "\n".join(r)) for r in runs]
        lines = [x.replace(" ", self.letters[32]) if x.isascii() else x.translate(self.letters) for x in lines]
        ids = np.array([i for x in self.pieces.encode_batch_fast(lines, add_special_tokens=False) for i in x.ids], "<u4")
        end = 1 + np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(size))
        return ids, np.diff(end, prepend=0)

    def _other(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of other words, the library's way, many a call with a mark between them that no word holds."""
        mark, between = ("\x01", " \x01 ") if self.word_style else ("\n", "\n")
        n, ids = np.zeros(len(words), np.int64), []
        sign = self._flat([mark])[0][0]
        alone = [k for k, w in enumerate(words) if mark in w]
        rest = [k for k, w in enumerate(words) if mark not in w]
        runs = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        flat, of = self._flat([between.join(words[k] for k in r) for r in runs] + [words[k] for k in alone])
        got = np.split(flat, np.cumsum(of)[:-1])
        out: list[np.ndarray] = [flat[:0]] * len(words)
        for run, x in zip(runs, got):
            cut = np.r_[-1, np.flatnonzero(x == sign), len(x)]
            for k, s, e in zip(run, cut.tolist(), cut[1:].tolist()):
                out[k] = x[s + 1 : e]
        for k, x in zip(alone, got[len(runs) :]):
            out[k] = x
        for k, x in enumerate(out):
            n[k] = len(x)
            ids.append(x)
        return (np.concatenate(ids) if ids else flat[:0]), n

    def _learn(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new parts, one after another, and how many each has."""
        lead = np.zeros(len(parts), "<U1")
        if self.word_style:
            words = pa.array("\n".join(parts.to_pylist()).lower().split("\n"), pa.string())
        else:
            start = pc.utf8_slice_codeunits(parts, 0, 1)
            lead = np.where(pc.equal(start, "\n").to_numpy(False), "\n", np.where(pc.equal(start, "\0").to_numpy(False), "0", " "))
            words = pc.utf8_ltrim(parts, "\n\0")
        heads = pc.utf8_rtrim(words, TAILS)
        quick = pc.match_substring_regex(heads, LETTERS).to_numpy(False)
        buffers, sizes = [self.line_feed], [np.array([len(self.line_feed)])]
        at = np.zeros((len(parts), 3), np.int64)  # line feed, word, marks: places among all runs; 0 is the line feed
        has = np.zeros((len(parts), 3), bool)
        has[:, 0] = lead == "\n"

        def add(rows: np.ndarray, column: int, which: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            at[rows, column] = sum(map(len, sizes)) + which
            has[rows, column] = True
            buffers.append(ids)
            sizes.append(n)

        for blank in (False, True):
            rows = np.flatnonzero(quick & ((lead == " ") == blank))
            own = heads.take(pa.array(rows)).dictionary_encode()
            add(rows, 1, own.indices.to_numpy(), *self._one_piece(own.dictionary, blank))
        behind = (pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy()) * quick
        rows = np.flatnonzero(behind)
        marks = pa.array([w[-k:] for w, k in zip(words.take(pa.array(rows)).to_pylist(), behind[rows].tolist())], pa.string()).dictionary_encode()
        add(rows, 2, marks.indices.to_numpy(), *self._flat(marks.dictionary.to_pylist()))
        rows = np.flatnonzero(~quick)
        rest = (parts if self.word_style else words).take(pa.array(rows)).to_pylist()  # the library makes its own lower case
        rest = [f" {w}" if b == " " else w for b, w in zip(lead[rows].tolist(), rest)]
        add(rows, 1, np.arange(len(rows)), *self._other(rest))
        n = np.concatenate(sizes)
        first = np.cumsum(n) - n
        each = np.where(has, n[at], 0)
        return _gather(np.concatenate(buffers), first[at].reshape(-1), each.reshape(-1)), each.sum(axis=1)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the words are kept; new ones are learnt."""
        self.now += 1
        if len(self.words) > KEPT:
            self._forget()
        keys = _hashes(words)
        by = np.argsort(keys)  # in order, so neighbours are looked for side by side
        near = np.minimum(np.searchsorted(self.keys, keys[by]), len(self.keys) - 1)
        at = np.full(len(words), -1)
        hit = by[self.keys[near] == keys[by]] if len(self.keys) else by[:0]
        maybe = self.where[near[self.keys[near] == keys[by]]] if len(self.keys) else hit
        same = pc.equal(words.take(pa.array(hit)), self.words.take(pa.array(maybe))).to_numpy(False)  # words with one hash are told apart
        at[hit[same]] = maybe[same]
        new = np.flatnonzero(at < 0)
        if len(new):
            more = words.take(pa.array(new))
            ids, n = self._learn(more)
            at[new] = len(self.words) + np.arange(len(new))
            self.first = np.concatenate([self.first, (len(self.known) + np.cumsum(n) - n).astype(np.int32)])
            self.words, self.known = pa.concat_arrays([self.words, more]), np.concatenate([self.known, ids])
            self.n, self.used = np.concatenate([self.n, n.astype(np.int32)]), np.concatenate([self.used, np.zeros(len(n), np.int32)])
            by = new[np.argsort(keys[new])]
            place = np.searchsorted(self.keys, keys[by])
            self.keys, self.where = np.insert(self.keys, place, keys[by]), np.insert(self.where, place, at[by].astype(np.int32))
        self.used[at] = self.now
        return at

    def _forget(self) -> None:
        """Keep the half of the words that were used last."""
        stay = self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        stay &= self.used > self.used.min()
        self.words = self.words.filter(pa.array(stay))
        self.known = _gather(self.known, self.first[stay], self.n[stay])
        self.n, self.used = self.n[stay], self.used[stay]
        self.first = (np.cumsum(self.n) - self.n).astype(np.int32)
        kept = stay[self.where]
        self.keys, self.where = self.keys[kept], (np.cumsum(stay, dtype=np.int32) - 1)[self.where[kept]]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        held, size = [], 0
        for text in texts:
            held.append(text)
            if (size := size + len(text)) > AT_ONCE:
                out += self._ids(held)
                held, size = [], 0
        out += self._ids(held)
        pa.default_memory_pool().release_unused()
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        whole = [self._has_added(t) or not self.word_style and not _regular(t) for t in texts]
        odd, of = self._flat([t for t, w in zip(texts, whole) if w])
        odd_end = np.cumsum(of)
        parts = self._parts([t for t, w in zip(texts, whole) if not w])
        words = parts.flatten().dictionary_encode()  # each word once, and where it stands
        at = self._places(words.dictionary)[words.indices.to_numpy()]
        n = self.n[at]
        raw = _gather(self.known, self.first[at], n).tobytes()
        cut = (4 * np.concatenate([[0], np.cumsum(n)])[parts.offsets.to_numpy()]).tolist()
        spans, plain = iter(zip(cut, cut[1:])), iter(zip((odd_end - of).tolist(), odd_end.tolist()))
        return [odd[slice(*next(plain))].tobytes() if w else raw[slice(*next(spans))] for w in whole]


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Batches in smaller ones: what a text becomes is larger than the text."""
    for x in batches:
        for s in range(0, max(len(x), 1), rows):
            yield x.iloc[s : s + rows]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and file, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
