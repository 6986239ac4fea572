"""Reading of public BPE vocabulary files (JSON of the ``tokenizers`` library).

Only what the two supported files use is understood: byte-level symbols, optional end-of-word
suffix, NFC + lower case or no normaliser, and added tokens that are matched in the raw text.
Anything else raises, so no file is ever counted by wrong rules.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import regex

# White space as the library's pattern engine sees it, and its split patterns.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
WORD_LEVEL = rf"{CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte value."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


@dataclass
class Vocabulary:
    ranks: dict[int, int]            # left id << 20 | right id  ->  rank of the merge
    merged: list[int]                # rank -> id of the merged symbol
    byte_ids: list[int]              # byte -> id of its symbol
    final_ids: list[int]             # byte -> id of its symbol at a word's end
    strings: dict[int, str]          # id -> vocabulary string
    added: dict[str, int]            # added tokens found in raw text
    split: regex.Pattern = field(repr=False)
    lower: bool = False
    splitter: regex.Pattern | None = None


def parse(data: bytes) -> Vocabulary:
    j = json.loads(data)
    model, vocab = j["model"], j["model"]["vocab"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
        raise ValueError("not a plain byte-level BPE file")
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in j["added_tokens"]):
        raise ValueError("added tokens with white space or normaliser rules are not supported")
    suffix = model.get("end_of_word_suffix") or ""
    norm, pre = j.get("normalizer"), j["pre_tokenizer"]
    if norm is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        lower, pattern = False, BYTE_LEVEL
    elif norm and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"] and pre["type"] == "Sequence":
        lower, pattern = True, WORD_LEVEL
    else:
        raise ValueError("unknown normaliser or split rule")
    ranks, merged = {}, []
    for rank, m in enumerate(model["merges"]):
        left, right = m if isinstance(m, list) else m.split(" ")
        ranks.setdefault(vocab[left] << 20 | vocab[right], rank)
        merged.append(vocab[left + right])
    chars = byte_characters()
    added = {t["content"]: t["id"] for t in j["added_tokens"]}
    strings = {i: s for s, i in vocab.items()} | {i: s for s, i in added.items()}
    splitter = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
    return Vocabulary(ranks, merged, [vocab[c] for c in chars], [vocab[c + suffix] for c in chars], strings, added,
                      regex.compile(pattern), lower, splitter)


_parsed: dict[int, Vocabulary] = {}


def shared(broadcast) -> Vocabulary:
    """The vocabulary of a broadcast file (its size is that of the file), parsed once per worker."""
    data = broadcast.value
    key = hash(data)
    if key not in _parsed:
        _parsed[key] = parse(data)
    return _parsed[key]
