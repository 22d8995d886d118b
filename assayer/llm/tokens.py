"""Token ids of whole texts, with each distinct piece of text encoded once per task.

For a tokenizer whose pre-tokenizer never joins text across ASCII white space,
a text's ids are those of its white-space-separated pieces in order; loading checks
that on probes and refuses other tokenizers. Pieces repeat heavily, so a task
keeps the ids of those it has met and hands only new ones to the library, in one
batch. Cutting, looking up and putting together are Arrow kernels.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import last_bytes, split_words, text_runs

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
TAILS = (("word", "."), ("Ab9", "),"), ("don't", "!'"), ("7", "..."), ("x", "_-"))
PROBES = ("the cat sat", "  Two\n\tlines,  and more. ", "x 1 22 é ß\x0bü 'll don't", "<b> a-b _ c_d </b>", "日本 語 ½ ²")
_loaded: dict[str, object] = {}
_encoders: dict[str, "PieceEncoder"] = {}


def load_tokenizer(path: str):
    """The tokenizer of a ``tokenizers`` JSON file, one copy per Python process, on one thread."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


class TwoGenerations:
    """A bounded map that forgets what has not been used for a while.

    New and used entries live in the young half; when it is full it becomes the
    old half and the former old one goes.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def want(self, keys: set) -> list:
        """Make room, keep what is known of ``keys`` young and return the rest."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        rest = keys - self.young.keys()
        held = rest & self.old.keys()
        self.young.update((k, self.old[k]) for k in held)
        return list(rest - held)


def check_pieces(tokenizer, path: str) -> None:
    """Raise where white space takes part in a token or decides on its neighbours."""
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    for probe in PROBES:
        if ids(probe) != [i for piece in probe.encode().split() for i in ids(piece.decode())]:
            raise ValueError(f"{path}: the ids of a text aren't those of its white-space-separated pieces")


def _gathered(bounds: np.ndarray, flat: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many ids the entries at ``place`` have, and all of them in a row; entry i has ``bounds[i]`` to ``bounds[i + 1]``."""
    lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(flat))
    return np.diff(bounds)[place], lists.take(pa.array(place)).flatten().to_numpy(zero_copy_only=False)


class PieceEncoder:
    """Ids of whole texts; ``piece_encoder`` keeps one per Python process.

    ``limit`` bounds the parts that are remembered; beyond it only those of the
    texts at hand are kept. Where the tokenizer allows (probes tell), A-Z count as
    a-z and punctuation at the end of a piece is looked up apart, so that fewer
    distinct parts reach the library; pieces with other than ASCII characters, and those
    that hold a special token in any case, go to it as they are.
    """

    def __init__(self, path: str, limit: int = 400_000, step: int = 3 << 20):
        self.tokenizer, self.limit, self.step = load_tokenizer(path), limit, step
        check_pieces(self.tokenizer, path)
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.lower = all(ids(p) == ids(p.lower()) for p in ("ABC", "XyZ-Q's", "IJ'LL"))
        self.tails = all(ids(a + b) == ids(a) + ids(b) for a, b in TAILS)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = pa.array([b""], pa.binary())
        self.flat, self.bounds = np.empty(0, dtype=np.uint32), np.zeros(2, dtype=np.int64)

    def _parts(self, pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
        """A head and a tail of each piece that are encoded apart; most tails are empty."""
        text = pieces.view(pa.string())
        small = pc.ascii_lower(text)
        plain = pc.string_is_ascii(text).to_numpy(zero_copy_only=False).copy()
        for token in self.special:  # lower case may make one
            for form in (text, small):
                plain &= ~pc.match_substring(form, token).to_numpy(zero_copy_only=False)
        head = text
        if self.tails:
            trimmed = pc.ascii_rtrim(text, characters=PUNCTUATION)
            sizes = pc.binary_length(trimmed).to_numpy(zero_copy_only=False)
            last = np.zeros(len(text), dtype=np.int64)
            last[sizes > 0] = last_bytes(trimmed.filter(pa.array(sizes > 0)).view(pa.binary()))[0]
            after = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 48) & (last <= 57)  # an ASCII letter or digit
            cut = plain & after & (sizes < pc.binary_length(text).to_numpy(zero_copy_only=False))
            head = pc.if_else(pa.array(cut), trimmed, text)
            at = np.flatnonzero(cut)
            tail = np.full(len(text), b"", dtype=object)
            tail[at] = [p[n:] for p, n in zip(pieces.take(pa.array(at)).to_pylist(), sizes[at].tolist())]
            tail = pa.array(tail, pa.binary())
        else:
            tail = pa.array(np.full(len(text), b"", dtype=object), pa.binary())
        if self.lower:
            head = pc.if_else(pa.array(plain), pc.ascii_lower(head), head)  # where it has other letters, marks may join them first
        return head.view(pa.binary()), tail

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Where each distinct part stands in ``bounds``, after encoding those that are new."""
        place = pc.index_in(parts, value_set=self.known)
        fresh = parts.filter(pc.is_null(place))
        if len(self.known) + len(fresh) > self.limit:
            held = np.union1d([0], pc.drop_null(place).to_numpy(zero_copy_only=False))
            counts, self.flat = _gathered(self.bounds, self.flat, held)
            self.known, self.bounds = self.known.take(pa.array(held)), np.concatenate([[0], np.cumsum(counts)])
            place = pc.index_in(parts, value_set=self.known)
        words = [p.decode("utf-8", "replace") for p in fresh.to_pylist()]
        counts, flat = [], []
        for i in range(0, len(words), 4000):  # what the library returns takes some kilobytes a word
            for e in self.tokenizer.encode_batch_fast(words[i : i + 4000], add_special_tokens=False):
                ids = e.ids
                counts.append(len(ids))
                flat.extend(ids)
        first = len(self.known)
        self.known = pa.concat_arrays([self.known, fresh])
        self.flat = np.concatenate([self.flat, np.array(flat, dtype=np.uint32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.array(counts, dtype=np.int64))])
        out = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out[pc.is_null(place).to_numpy(zero_copy_only=False)] = first + np.arange(len(fresh))
        return out

    def _runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per run of texts: bounds and ids of its distinct pieces, each word's piece, and the words of each text."""
        for run in text_runs(texts, self.step):
            words, counts = split_words(run, lower=False)
            coded = words.dictionary_encode()
            parts = pa.concat_arrays(self._parts(coded.dictionary)).dictionary_encode()
            place = self._learn(parts.dictionary)[parts.indices.to_numpy(zero_copy_only=False)].reshape(2, -1).T.ravel()
            sizes, flat = _gathered(self.bounds, self.flat, place)
            yield np.concatenate([[0], np.cumsum(sizes)])[::2], flat, coded.indices.to_numpy(zero_copy_only=False), counts

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each binary text; null and blank texts have none."""
        out = [np.empty(0, dtype=np.int64)]
        for bounds, _, piece, counts in self._runs(texts):
            sums = np.concatenate([[0], np.cumsum(np.diff(bounds)[piece])])
            out.append(np.diff(sums[np.concatenate([[0], np.cumsum(counts)])]))
        return np.concatenate(out)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The uint32 ids of each binary text."""
        for bounds, flat, piece, counts in self._runs(texts):
            sizes, ids = _gathered(bounds, flat, piece)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            yield from (ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
