"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

A byte-level BPE never merges across a single space or newline between two other characters, and one whose
pre-tokenizer drops white space never merges across any. Texts are cut there, the library encodes each distinct piece, and
the ids are joined. Pieces of letters alone go to the library many at a time. Texts with other or doubled white space, NULs or special-token marks are encoded whole.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidelog.llm.common import claim

#: Pieces remembered by a worker; those that come when it is full are encoded again each time (about 130 MB at most).
REMEMBERED = 600_000
LONGEST = 64
#: Pieces of letters in one call of the library.
CHUNK = 200
#: Marks that either pre-tokenizer cuts off from letters before them, as one piece.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_ALONE = ["\n", " "]
#: Any white space but space and newline, and NUL.
_ODD = r"[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _mode(path: str) -> str:
    conf = json.loads(Path(path).read_text())
    pre, norm = conf.get("pre_tokenizer") or {}, conf.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and norm is None:
        return "bytes"
    steps = pre.get("pretokenizers", [])
    kinds = {n.get("type") for n in (norm or {}).get("normalizers", [])}
    if steps and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and kinds <= {"NFC", "Replace", "Lowercase"}:
        return "words"
    return "whole"


class Encoder:
    """Encodes batches of texts; a null counts as empty."""

    def __init__(self, path: str, remembered: int | None = None):
        self.most = REMEMBERED if remembered is None else remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.mode = Tokenizer.from_file(path), _mode(path)
        self.known: dict[str, bytes] = {"": b""}
        if self.mode != "whole":
            # the same vocabulary and merges for runs of letters alone, which either pre-tokenizer leaves in one piece
            self.apart = "\n" if self.mode == "bytes" else " "
            self.letters = Tokenizer.from_file(path)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(self.apart, "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.known |= dict(zip(_ALONE, self._ids(_ALONE), strict=True))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces of letters (in bytes mode, of a space and letters too), many in a call."""
        out, chunks = {}, [pieces[i : i + CHUNK] for i in range(0, len(pieces), CHUNK)]
        for chunk, e in zip(chunks, self.letters.encode_batch([self.apart.join(c) for c in chunks], add_special_tokens=False), strict=True):
            words = np.asarray(e.word_ids)
            cuts = [0, *((np.flatnonzero(words[1:] != words[:-1]) + 1) * 4).tolist(), 4 * len(words)]
            ids = np.asarray(e.ids, dtype="<u4").tobytes()
            own = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] if len(cuts) == len(chunk) + 1 else self._ids(chunk)
            out.update(zip(chunk, own, strict=True))
        return out

    def _letters(self, word: str) -> bool:
        """Whether a word is letters alone, also in the form that the words mode's normalizer gives it (a lower case may hold marks)."""
        return word.isalpha() and (self.mode == "bytes" or word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())

    def _learn(self, missing: set[str]) -> None:
        """Adds the ids of all missing pieces to known."""
        known, runs, ended, rest = self.known, set(), [], []
        for piece in missing:
            word = piece[1:] if piece[0] == " " else piece
            if self._letters(word):
                runs.add(piece)
            elif self._letters(start := word.rstrip(_MARKS)):
                ended.append((piece, piece[: len(piece) - len(word) + len(start)], word[len(start) :]))
            else:
                rest.append(piece)
        runs.update(start for _, start, _ in ended)
        runs = [piece for piece in runs if piece not in known]
        known.update(self._runs(runs))
        rest += {marks for _, _, marks in ended}.difference(known, rest)
        known.update(zip(rest, self._ids(rest), strict=True))
        known.update((piece, known[start] + known[marks]) for piece, start, marks in ended)

    def _uncuttable(self, texts: pa.Array) -> pa.Array:
        marks = ["<|"] if self.mode == "words" else ["<|", "  ", "\n\n", " \n", "\n "]
        found = [pc.match_substring(texts, m) for m in marks] + [pc.match_substring_regex(texts, _ODD if self.mode == "bytes" else "\\x00")]
        return functools.reduce(pc.or_, found)

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        if self.mode == "words":
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other (uint32), and where each text's start, and the end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        apart = pa.array(np.full(len(texts), True)) if self.mode == "whole" else self._uncuttable(texts)
        whole = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        if self.mode == "whole":
            flat, starts = np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        else:
            flat, starts = self._cut(pc.if_else(apart, "", texts))
        if not len(whole):
            return flat, starts
        parts = [flat[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        for i, ids in zip(whole, self._ids(texts.take(pa.array(whole)).to_pylist()), strict=True):
            parts[i] = np.frombuffer(ids, "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        known, before = self.known, len(self.known)
        lists = self._pieces(texts)
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if missing := set(distinct).difference(known):
            self._learn(missing)
        own = list(map(known.__getitem__, distinct))
        ids = np.frombuffer(b"".join(own), "<u4")
        sizes = np.fromiter(map(len, own), np.int32, len(own)) // np.int32(4)
        of = coded.indices.to_numpy()
        length = sizes[of]
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        at = np.repeat(((np.cumsum(sizes, dtype=np.int64) - sizes)[of] - ends[:-1]).astype(np.int32), length)
        at += np.arange(ends[-1], dtype=np.int32)
        flat = ids[at]
        starts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        over = len(known) - self.most
        for n, piece in enumerate(list(itertools.islice(reversed(known), len(known) - before))):  # newest first
            if n < over or len(piece) > LONGEST:
                del known[piece]
        return flat, starts


def ended(flat: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    n = np.arange(len(starts))
    out = np.empty(len(flat) + len(starts) - 1, "<u4")
    stays = np.ones(len(out), bool)
    stays[starts[1:] + n[:-1]] = False
    out[stays] = flat
    out[~stays] = end
    return out, starts + n


def encoder(path: str, remembered: int | None = None) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    kept = claim("encoding")
    if path not in kept:
        kept[path] = Encoder(path, remembered)
    return kept[path]
