"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a batch lie in one symbol array with links to the
next and previous symbol. An index maps the rank of each mergeable pair to all
positions where it occurs; ranks are applied in ascending order to all their
positions at once, and the pairs that appear beside the merged symbols are added
to the lists of their own ranks. Stale positions are dropped when a list is used.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TwoGenerations, load_tokenizer
from .workspace import ship

#: Fixed by the vocabulary file: how its pre-tokenizer splits lower-cased ASCII text.
ASCII_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

#: Fixed by the format: what a file must say for the split above, the normaliser and the decoding here to be its own.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_models: dict[str, "PairIndexBpe"] = {}


def check_file(spec: dict, path: str) -> None:
    """Raise unless the tokenizer file is a byte-level, word-end-marked BPE with the split, normaliser and decoding known here."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    kinds = {
        "its normaliser": (spec.get("normalizer") or {}).get("normalizers") == NORMALISERS,
        "its split": len(steps) == 2 and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed",
        "its bytes": steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space") and not steps[-1].get("use_regex"),
        "its decoder": spec.get("decoder") is None,
        "its model": model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not any(model.get(n) for n in ("unk_token", "continuing_subword_prefix", "dropout", "byte_fallback", "ignore_merges")),
        "its added tokens": all(t["content"].startswith("<|") and not any(t.get(n) for n in ("normalized", "lstrip", "rstrip", "single_word")) for t in spec["added_tokens"]),
    }
    wrong = [n for n, right in kinds.items() if not right]
    if wrong:
        raise ValueError(f"{path}: {', '.join(wrong)} can't be encoded here")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class PairIndexBpe:
    """Encoder of a byte-level, word-end-marked BPE file."""

    def __init__(self, path: str, limit: int = 200_000):
        spec = json.load(open(path, encoding="utf-8"))
        check_file(spec, path)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token.decode()
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.to_bytes = {ord(c): chr(b) for b, c in enumerate(letters)}
        self.size = len(self.tokens)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._check_order()
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.text_ids = [str(i) for i in range(self.size)]
        self.library = load_tokenizer(path)
        self.split_special = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        self.words, self.pieces = TwoGenerations(limit), TwoGenerations(limit)

    def _check_order(self) -> None:
        """A merge must come after those that make its parts; then applying whole
        ranks in ascending order equals merging one lowest-ranked pair at a time."""
        born = np.full(self.size, -1, dtype=np.int64)
        born[self.made[::-1]] = np.arange(len(self.made) - 1, -1, -1)
        last = np.full(self.size, -1, dtype=np.int64)
        np.maximum.at(last, self.made, np.arange(len(self.made)))
        ranks = np.arange(len(self.made))
        if (last[self.left] >= ranks).any() or (last[self.right] >= ranks).any() or (born[self.made] != last[self.made]).any():
            raise ValueError("this vocabulary's merges are not in order of construction")

    def _index(self, symbol: np.ndarray, after: np.ndarray, at: np.ndarray, lists: dict[int, list[np.ndarray]], active: list[int]) -> None:
        """Add the mergeable pairs that start at ``at`` to the occurrence lists."""
        at = at[after[at] >= 0]
        keys = symbol[at] * self.size + symbol[after[at]]
        found = np.searchsorted(self.keys, keys)
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == keys
        at, ranks = at[hit], self.ranks[found[hit]]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
            if rank not in lists:
                heapq.heappush(active, rank)
            lists[rank].append(part)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct non-empty pre-tokens, one after another, and where each begins."""
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        lists: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []
        self._index(symbol, after, np.arange(len(raw)), lists, active)
        while active:
            rank = heapq.heappop(active)
            parts = lists.pop(rank)
            at = np.unique(np.concatenate(parts))
            a, b = self.left[rank], self.right[rank]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # of a run of equal symbols every second pair, from the left
                starts = np.concatenate([[True], at[1:] != after[at[:-1]]])
                first = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            symbol[at], symbol[gone] = self.made[rank], -1
            after[at] = then
            linked = then >= 0
            before[then[linked]] = at[linked]
            ahead = before[at]
            self._index(symbol, after, np.concatenate([ahead[ahead >= 0], at]), lists, active)
        alive = symbol >= 0
        begins = np.concatenate([[0], np.cumsum(alive)[ends - 1]])
        return symbol[alive], begins

    def pre_tokens(self, piece: bytes) -> list[bytes]:
        """The pre-tokens of a piece of text without ASCII white space."""
        if piece.isascii():
            return ASCII_SPLIT.findall(piece.lower())
        text = self.library.normalizer.normalize_str(piece.decode("utf-8", "replace"))
        return [t.translate(self.to_bytes).encode("latin-1") for t, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, pieces: set[bytes]) -> None:
        """Make the ids and tokens of all ``pieces`` known, encoding those that are new together."""
        new = self.pieces.want(pieces)
        cut: list[list[bytes]] = []
        for piece in new:
            if self.split_special and b"<|" in piece:
                cut.append([w for part in self.split_special.split(piece) if part for w in ([part] if part in self.special else self.pre_tokens(part))])
            else:
                cut.append(self.pre_tokens(piece))
        fresh = self.words.want({w for words in cut for w in words} - self.special.keys())
        known = self.words.young
        for i in range(0, len(fresh), 200_000):
            words = fresh[i : i + 200_000]
            ids, begins = self.merge_words(words)
            ids, begins = ids.tolist(), begins.tolist()
            for word, a, b in zip(words, begins, begins[1:]):
                part = ids[a:b]
                known[word] = " ".join([self.text_ids[x] for x in part]), " ".join([self.tokens[x] for x in part])
        for token, i in self.special.items():
            known[token] = self.text_ids[i], self.tokens[i]
        for piece, words in zip(new, cut):
            if len(words) == 1:
                self.pieces.young[piece] = known[words[0]]
            else:
                parts = [known[w] for w in words]
                self.pieces.young[piece] = " ".join([p[0] for p in parts]), " ".join([p[1] for p in parts])

    def encode(self, texts: list[bytes | None], step: int = 8 << 20) -> Iterator[tuple[str, str]]:
        """Space-joined decimal ids and the decoded text of each text, ``step`` bytes at a time."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") <= step):
                size += len(texts[j] or b"")
                j += 1
            split = [(t or b"").split() for t in texts[i:j]]
            self.learn({p for words in split for p in words})
            get = self.pieces.young.__getitem__
            for words in split:
                found = [x for x in map(get, words) if x[0]]
                yield " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
            i = j


def encoder(path: str) -> PairIndexBpe:
    if path not in _models:
        _models[path] = PairIndexBpe(path)
    return _models[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids string, decoded string)`` per row: decimal ids joined by one space, and the decoded text.

    Null and empty texts have no ids. Repeated rows and null ids keep a row each, very
    long texts are encoded whole, and an empty table gives no rows. Other columns are
    ignored, whatever their names. The pair index covers a step of 8 MB of a task's
    texts at a time. The vocabulary has no decoder, so decoding joins its tokens by one space.
    """
    return _map(docs, tokenizer_path, id_col, text_col, "ids string, decoded string", lambda ids, text: (ids, text), [pa.string(), pa.string()])


def digest_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, but ``(id, n_tokens, ids_sha256, decoded_sha256)``, hashed where the ids are made."""

    def digest(ids: str, text: str) -> tuple[int, str, str]:
        return ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _map(docs, tokenizer_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest, [pa.int64(), pa.string(), pa.string()])


def _map(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, make, types: list[pa.DataType]) -> DataFrame:
    ship(docs.sparkSession)
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            rows = [make(*x) for x in model.encode(batch.column(1).to_pylist())]
            cells = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cells, types))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, {columns}")
