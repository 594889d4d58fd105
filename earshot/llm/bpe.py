"""Byte-pair encoding by a deterministic automaton, and decoding by its arc labels.

The automaton reads tokens: its arcs carry token ids, and its paths spell exactly the token sequences that the
merges produce. It starts with one state that reads every byte. Each merge (u, v) -> w in turn applies the merge
gadget: wherever u leads to a state that v leaves, w becomes an arc from before u to after v, and the state after u
loses v. A state is therefore known by the token that led to it, and whether token t may leave the state of token s
follows from the merges alone by undoing the younger of the two (``Automaton.arc``). Arcs are tabulated when first
asked for, since the full table would have tokens squared entries. A word is encoded by walking arcs whose labels
spell it, longest first; a position from which no walk ends is never entered again, so the walk is linear.

Texts are cut into words as the tokenizer file says (byte-level, with or without the word pattern); added tokens
found in a text stay whole. Only byte-level BPE files without normalizer, dropout and unknown token are accepted.
Null text counts as empty, repeated rows get equal results, null ids stay, other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a Python worker remembers the ids of.
CACHE = 150_000
#: Arcs a Python worker remembers.
ARCS = 1_000_000
#: Characters encoded at once.
CHUNK_ROWS = 256

# The word pattern of byte-level tokenizer files, with white space spelled out.
_WS = r"\t-\r\x20\x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{{L}}+|\x20?\p{{N}}+|\x20?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
# The same for texts of ASCII and Latin letters only, where plain classes say the same and run faster.
_L = r"A-Za-zÀ-ÖØ-öø-ɏ"
PLAIN = r"[\x00-\x1b\x20-\x7eÀ-ɏ]*"
PLAIN_WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?[{_L}]+|\x20?[0-9]+|\x20?[^\t-\r\x20{_L}0-9]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+"


def byte_letters() -> dict[str, int]:
    """Byte-level files write each byte as a printable letter: itself, or the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The compiled merges, and the words encoded so far."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], added: dict[str, int], words: bool):
        self.labels, self.added, self.words = labels, added, words
        self.rank = [-1] * len(labels)
        self.parts: list[tuple[int, int] | None] = [None] * len(labels)
        self.pair: dict[tuple[int, int], int] = {}
        made = {w for _, _, w in merges}
        usable = {i for i, b in enumerate(labels) if len(b) == 1 and i not in made}
        if len(made) != len(merges):
            raise ValueError("two merges make the same token")
        for r, (u, v, w) in enumerate(merges):
            # the gadget adds w only where the path u, v is still there
            if u in usable and v in usable and self._leaves(u, v, r):
                self.rank[w], self.parts[w], self.pair[u, v] = r, (u, v), r
                usable.add(w)
        #: Every beginning of a label, with the token it is, or -1.
        self.prefix: dict[bytes, int] = {}
        for i in usable:
            for end in range(1, len(labels[i])):
                self.prefix.setdefault(labels[i][:end], -1)
            self.prefix[labels[i]] = i
        self.ready()

    def ready(self) -> None:
        self.arcs: dict[int, bool] = {}
        self.ids = _Known(self)
        self.pattern, self.plain, self.plain_pattern = regex.compile(WORD), re.compile(PLAIN), re.compile(PLAIN_WORD)
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "ids", "pattern", "plain", "plain_pattern", "special")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def _leaves(self, s: int, t: int, before: float) -> bool:
        """Whether ``t`` leaves the state after ``s`` once the merges of a rank below ``before`` are applied."""
        rank, parts, pair = self.rank, self.parts, self.pair
        while True:
            cut = pair.get((s, t))
            if cut is not None and cut < before:
                return False
            if rank[s] < 0 and rank[t] < 0:
                return True
            if rank[s] > rank[t]:  # s came later: its state was a copy of the state after its second part
                before, s = rank[s], parts[s][1]
            else:  # t came later, from its first part; the same merge at the left had taken that arc away
                before, t = rank[t] + 1, parts[t][0]

    def arc(self, s: int, t: int) -> bool:
        key = s * len(self.labels) + t
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._leaves(s, t, float("inf"))
        return known

    def walk(self, word: bytes) -> list[int]:
        """The arcs from the start state that spell ``word``, longest label first."""
        prefix, arcs, labels = self.prefix.get, self.arcs.get, self.labels
        size, n, at, last = len(labels), len(word), 0, -1
        path: list[int] = []
        waiting: list[list[int]] = []  # for each place on the path the shorter labels not yet tried
        dead: set[int] = set()
        choices: list[int] | None = None
        while at < n:
            if choices is None:
                choices, end = [], at + 1
                while end <= n:
                    t = prefix(word[at:end])
                    if t is None:
                        break
                    if t >= 0:
                        choices.append(t)
                    end += 1
            while choices:
                t = choices.pop()
                if last >= 0:
                    open_ = arcs(last * size + t)
                    if not (self.arc(last, t) if open_ is None else open_):
                        continue
                if dead and at + len(labels[t]) in dead:
                    continue
                path.append(t)
                waiting.append(choices)
                at, last, choices = at + len(labels[t]), t, None
                break
            else:  # no walk from here
                dead.add(at)
                at -= len(labels[path.pop()])
                choices, last = waiting.pop(), path[-1] if path else -1
        return path

    def _plain_ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.words:
            found = [text]
        elif self.plain.fullmatch(text):
            found = self.plain_pattern.findall(text)
        else:
            found = self.pattern.findall(text)
        return b"".join(map(self.ids.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.ids) > CACHE:  # words in use come back from the older half
            self.ids.older = dict(self.ids)
            self.ids.clear()
        if self.special is None or not any(x in text for x in self.added):
            return self._plain_ids(text)
        return b"".join(
            self.added[x].to_bytes(4, "little") if i % 2 else self._plain_ids(x) for i, x in enumerate(self.special.split(text))
        )

    def decode(self, ids: bytes) -> str:
        """The labels along the path."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _Known(dict):
    """Ids of words, made when first asked for."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            path = self.automaton.walk(word.encode("utf-8", "replace"))
            found = struct.pack(f"<{len(path)}I", *path)
        self[word] = found
        return found


def compile_file(path: str) -> Automaton:
    """The automaton of a tokenizer file."""
    with open(path, "rb") as f:
        return compile_spec(f.read())


def _checked(content: bytes) -> dict:
    spec = json.loads(content)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    plain_added = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in spec["added_tokens"])
    if model["type"] != "BPE" or odd or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not plain_added:
        raise ValueError("not a plain byte-level BPE file")
    return spec


def compile_spec(content: bytes) -> Automaton:
    """The automaton of a tokenizer file's content."""
    spec = _checked(content)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    letters, vocab = byte_letters(), model["vocab"]
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    labels = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for token, i in vocab.items():
        labels[i] = bytes(letters[c] for c in token)
    for token, i in added.items():
        labels[i] = token.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], added, pre.get("use_regex", True))


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, the ids (little-endian 32-bit) of each row."""
    with open(path, "rb") as f:
        content = f.read()
    _checked(content)  # a wrong file fails here; workers compile it, so that the driver never holds an automaton
    shared = docs.sparkSession.sparkContext.broadcast(content)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker keeps the broadcast between its tasks, and with it the automaton and the words it knows
        if not hasattr(shared, "automaton"):
            shared.automaton = compile_spec(shared.value)
        automaton = shared.automaton
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(first, CHUNK_ROWS)
                ids = [automaton.encode(x.as_py() or "") for x in part.column("text")]
                back = [automaton.decode(x) for x in ids]
                columns = [
                    part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in back]), pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
