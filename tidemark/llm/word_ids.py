"""Whole texts to token ids with a tokenizer file, each different word encoded once while remembered.

The ids are those of the ``tokenizers`` library for the whole text without added special tokens; a
special token's own string in a text is that token, as in the library. Two kinds of files are known,
for which a text can be cut where no piece of the pre-tokenizer crosses:

* ``spaced``: the byte-level pattern. A single space between other characters begins a new piece.
* ``plain``: lower case, white space dropped. No piece holds white space.

A word of Latin letters, digits and marks (no apostrophe, which may begin a contraction) is parted
into the pieces that the pattern makes, and the file's own model encodes each. All other words, texts
with a special token's string or with runs of white space, and other files go through the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

KNOWN_WORDS = 500_000
KNOWN_IDS = 8_000_000

# fixed values: what the two kinds of files hold
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_PATTERN = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
MARK = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# texts in which a space touches other white space
RUN_OF_WHITE = f" [{WHITE}]|[{WHITE}] "
ONE_LETTERS = re.compile(f" ?[{LETTER}]+")
SPACED_WORD = re.compile(f" ?[{LETTER}0-9{MARK}]+(?:\n[{LETTER}0-9{MARK}]+)*")
SPACED_PIECE = re.compile(f" ?[{LETTER}]+| ?[0-9]+| ?[{MARK}]+|\n")
PLAIN_WORD = re.compile(f"[{LETTER}0-9{MARK}]+")
PLAIN_PIECE = re.compile(f"[{LETTER}]+|[0-9]|[{MARK}]+")


def _byte_letters() -> str:
    """The letter by which byte-level vocabularies write each byte: printable bytes stand for
    themselves, the others follow from code 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


BYTE_LETTERS = _byte_letters()
SPACE = BYTE_LETTERS[32]


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start:start + size]`` one after another."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """An encoder that remembers up to ``KNOWN_WORDS`` words and then begins anew."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model
        self.added = [t["content"] for t in made["added_tokens"]]
        # a string that has to stand apart, or that the normalizer sees first, needs its whole text
        easy = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in made["added_tokens"])
        bpe = made["model"]["type"] == "BPE" and not made["model"].get("dropout") and made.get("post_processor") is None
        shape = made.get("normalizer"), made.get("pre_tokenizer")
        self.kind = None
        if easy and bpe:
            self.kind = {0: "spaced", 1: "plain"}.get(
                next((i for i, s in enumerate([(None, BYTE_LEVEL), (PLAIN_NORMALIZER, PLAIN_PATTERN)]) if s == shape), -1))
        self._forget()

    @staticmethod
    def of_worker(path: str) -> WordIds:
        """The encoder that this Python worker keeps for its tasks, so that words stay known."""
        kept = vars(sys).setdefault("_tidemark_word_ids", {})
        if path not in kept:
            kept[path] = WordIds(path)
        return kept[path]

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int64)
        self.used = 0

    def _room(self, words: int, ids: int) -> None:
        have = len(self.slot)
        if have + words > len(self.starts):
            more = max(have + words, 2 * len(self.starts)) - len(self.starts)
            self.starts = np.concatenate((self.starts, np.empty(more, np.int64)))
            self.sizes = np.concatenate((self.sizes, np.empty(more, np.int64)))
        if self.used + ids > len(self.flat):
            more = max(self.used + ids, 2 * len(self.flat)) - len(self.flat)
            self.flat = np.concatenate((self.flat, np.empty(more, np.uint32)))

    def _remember(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Give each new word a slot; ``ids`` are those of all words in a row."""
        self._room(len(words), len(ids))
        at = len(self.slot)
        self.flat[self.used:self.used + len(ids)] = ids
        self.sizes[at:at + len(words)] = sizes
        self.starts[at:at + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.slot.update(zip(words, range(at, at + len(words))))

    def _lists(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._remember(words, sizes, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())))

    def _of_model(self, pieces: list[str]) -> None:
        """Pieces of the pattern go to the model directly, written in byte letters."""
        run, ids, ends = self.model.tokenize, [], []
        for p in pieces:
            if p.isascii():
                letters = SPACE + p[1:] if p[0] == " " else BYTE_LETTERS[10] if p == "\n" else p
            else:
                letters = (p.lower() if self.kind == "plain" else p).encode().decode("latin-1").translate(BYTE_LETTERS)
            ids += [t.id for t in run(letters)]
            ends.append(len(ids))
        self._remember(pieces, np.diff(np.array(ends, np.int64), prepend=0), np.array(ids, np.uint32))

    def _learn(self, words: list[str]) -> None:
        """Remember different words that are not known yet."""
        whole, part = (SPACED_WORD, SPACED_PIECE) if self.kind == "spaced" else (PLAIN_WORD, PLAIN_PIECE)
        simple, composed, other = [], [], []
        for w in words:
            if ONE_LETTERS.fullmatch(w):
                simple.append(w)
            elif whole.fullmatch(w):
                composed.append(w)
            else:
                other.append(w)
        self._of_model(simple)
        parts = list(map(part.findall, composed))
        self._of_model([p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in self.slot])
        # a word of one piece is known by now
        parts = [(w, p) for w, p in zip(composed, parts) if w not in self.slot]
        if parts:
            counts = np.fromiter((len(p) for _, p in parts), np.int64, len(parts))
            slots = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(p for _, p in parts)), np.int64, int(counts.sum()))
            sizes = self.sizes[slots]
            ids = gather(self.flat, self.starts[slots], sizes)
            self._remember([w for w, _ in parts], np.add.reduceat(sizes, np.cumsum(counts) - counts), ids)
        if other:
            self._lists(other, self._whole(other))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _slots(self, words: list[str]) -> np.ndarray:
        """The slot of each of some different words."""
        new = [w for w in words if w not in self.slot]
        if new:
            self._learn(list(dict.fromkeys(new)))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def _by_word(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.slot) > KNOWN_WORDS or self.used > KNOWN_IDS:
            self._forget()
        if self.kind == "plain":
            split = pc.ascii_split_whitespace(pc.ascii_lower(batch))
        else:
            split = pc.split_pattern(batch, " ")
        flat, edges = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        found = flat.dictionary_encode()
        codes = found.indices.to_numpy()
        words = strings(found.dictionary)
        if self.kind == "plain":
            slots = self._slots(words)[codes]
        else:
            # a text's first word has no space before it
            first = edges[:-1]
            heads = flat.take(pa.array(first)).dictionary_encode()
            every = self._slots([" " + w for w in words] + [h for h in strings(heads.dictionary)])
            codes = codes.astype(np.int64)
            codes[first] = len(words) + heads.indices.to_numpy()
            slots = every[codes]
        sizes = self.sizes[slots]
        ids = gather(self.flat, self.starts[slots], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return ids, ends[edges]

    def __call__(self, batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, the texts' edges in them) of a string column without nulls."""
        if not len(batch):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        if self.kind is None:
            hard = np.ones(len(batch), bool)
        else:
            # the other case too: words are put in lower case before they meet the library
            tests = [pc.match_substring(batch, a, ignore_case=True) for a in self.added]
            tests += [pc.match_substring_regex(batch, RUN_OF_WHITE)] if self.kind == "spaced" else []
            hard = np.logical_or.reduce([t.to_numpy(zero_copy_only=False) for t in tests]) if tests else np.zeros(len(batch), bool)
        if not hard.any():
            return self._by_word(batch)
        easy_ids, easy_edges = np.empty(0, np.uint32), np.zeros(1, np.int64)
        if not hard.all():
            easy_ids, easy_edges = self._by_word(batch.filter(pa.array(~hard)))
        lists = self._whole(strings(batch.filter(pa.array(hard))))
        hard_sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        hard_ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(hard_sizes.sum()))
        sizes = np.empty(len(batch), np.int64)
        starts = np.empty(len(batch), np.int64)
        sizes[~hard], starts[~hard] = np.diff(easy_edges), easy_edges[:-1]
        sizes[hard], starts[hard] = hard_sizes, len(easy_ids) + np.cumsum(hard_sizes) - hard_sizes
        ids = gather(np.concatenate((easy_ids, hard_ids)), starts, sizes)
        return ids, np.concatenate(([0], np.cumsum(sizes)))
