"""Packing documents into token sequences by non-negative least squares over length combinations.

Documents are tokenised once and cut into pieces: full windows, then at most one half window
and a rest. Piece lengths are counted in units; shallow combinations of lengths that fill a
window are enumerated, NNLS finds how often to repeat each against the histogram, the counts
are rounded down, and what is left is packed greedily in groups of bounded size. Only the
histogram (fixed size) meets the driver; a piece finds its place from its rank among the
pieces of its length, which a distributed prefix count gives.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, exclusive_prefix, table, written
from .textgrams import blocks

WINDOW = 4096
UNIT = 32
DEPTH = 4
END_ID = 2
#: Windows of tokens that one group of the greedy rest holds.
GROUP = 64
VOCABULARY = "word_bpe_49k.json"
_RESIDUAL = 1 << 50
#: Words of a generation.
_MOST_WORDS = 200_000


#: How the vocabulary's file splits what it has lower-cased, for printable ASCII, its white space and the letters of Latin-1.
_RUNS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_END = b"\xff\xff\xff\xff"
#: The steps before the merges that this holds for, as the library writes them; a file with others goes through the library whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Bytes as the characters that byte-level merges are written in: printable ones stand for themselves, the others for 256 and on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: Stands behind a word's last byte for the vocabulary's end of a word: no byte of UTF-8.
_LAST = b"\xff"


def _merges(path: str, tokenizer) -> Callable[[bytes], list[int]] | None:
    """Ids of one run, its bytes and ``_LAST``, by merges in the order of ids; none where the file's normaliser, splits, special tokens or merges are others."""
    import tiktoken

    found = json.loads(Path(path).read_text(encoding="utf-8"))
    model, special = found["model"], [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    if found["normalizer"] != _NORMALIZER or found["pre_tokenizer"] != _SPLITS or not all(x.startswith("<|") for x in special) or any(model.get(k) != v for k, v in plain.items()):
        return None
    of = {chr(c): b for b, c in _BYTES.items()} | {chr(b): b for b in _PRINTABLE}
    ranks = {}
    for token, i in model["vocab"].items():
        if token not in special:
            ends = token.endswith("</w>")
            ranks[bytes(of[c] for c in (token[:-4] if ends else token)) + _LAST * ends] = i
    units = {bytes([b]) + end for b in range(256) for end in (b"", _LAST)}
    made = [model["vocab"].get("".join(x if isinstance(x, list) else x.split(" ")), -1) for x in model["merges"]]
    if {x for x, i in ranks.items() if i < 512} != units or made != list(range(512, 512 + len(made))):
        return None
    return tiktoken.Encoding("runs", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Tokens:
    """Token ids of whole texts, with a bounded memory of what words become.

    The vocabulary's splits never join what ASCII white space parts, so a text's ids are
    those of its white-space words one after the other. Words of texts in printable ASCII and
    Latin-1 letters are merged run by run, as bytes; other texts, texts that
    may hold a special token, and files of other normalisers or splits go through the whole
    tokenizer. Memory has two generations: words that a block needs move to the young one,
    and when that is full the old one goes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged = _merges(path, self.tokenizer)
        self.known: dict[str, bytes] = {"\n": _END}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > _MOST_WORDS:
            self.known, self.old = {"\n": _END}, self.known
        known, old = self.known, self.old
        words = [w for w in words if w not in known]
        new, mixed = [], []
        for w in words:
            if w in old:
                known[w] = old[w]
            elif w.isalpha():
                new.append(w)
            else:
                mixed.append(w)
        runs = _RUNS.findall("\n".join(mixed))
        for run in [*new, *(run for run in set(runs) if run not in known)]:
            known[run] = array("I", self.merged(run.encode() + _LAST)).tobytes()
        if mixed:  # the mark between words is no id's bytes, aligned or not
            known.update(zip(mixed, b"".join(map(known.__getitem__, runs)).split(_END), strict=True))

    def many(self, texts: list[str | None], end: int = END_ID) -> Iterator[np.ndarray]:
        """The ids of each text, and the end id; a null text is empty."""
        last = np.array([end], "<u4").tobytes()
        texts = [t or "" for t in texts]
        for first, stop in blocks(texts, 1 << 20):
            part = texts[first:stop]
            plain = [self.merged is not None and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in part]
            split = [t.lower().split() if p else None for t, p in zip(part, plain, strict=True)]
            self._learn(set().union(*(x for x in split if x is not None)))
            whole = [t.encode("utf-8", "replace").decode() for t, p in zip(part, plain, strict=True) if not p]
            other = iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else ())
            for words in split:
                if words is None:
                    yield np.array([*next(other).ids, end], "<u4")
                else:
                    yield np.frombuffer(b"".join(map(self.known.__getitem__, words)) + last, "<u4")


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each worker and file."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def cut(n: int, window: int = WINDOW) -> list[int]:
    """Lengths of the pieces of a document of n tokens: full windows, then a half window if more is left, then the rest."""
    pieces = [window] * (n // window)
    left = n % window
    if left > window // 2:
        pieces.append(window // 2)
        left -= window // 2
    return pieces + [left] * (left > 0)


def trimmed(n: int, window: int = WINDOW, unit: int = UNIT) -> list[int]:
    """``cut``, with a rest in two: whole units, which fill windows without a gap, and what is left."""
    return [x for p in cut(n, window) for x in (p - p % unit, p % unit) if x]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens) and, if asked for, ``ids``: little-endian 32-bit ids of the piece. A null text is empty and has the end id alone."""
    schema = f"start array<long>, length array<long>, ids_crc32 array<long>, doc_tokens long{', ids array<binary>' if with_ids else ''}"

    @F.pandas_udf(schema)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = tokens(path)
        for batch in texts:
            out = []
            for ids in own.many(batch.tolist()):
                lengths = trimmed(len(ids), window)
                starts = [0, *np.cumsum(lengths)[:-1].tolist()]
                raw = [ids[s : s + n].tobytes() for s, n in zip(starts, lengths, strict=True)]
                out.append((starts, lengths, [zlib.crc32(x) for x in raw], len(ids)) + ((raw,) if with_ids else ()))
            yield pd.DataFrame(out, columns=["start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    fields = ["start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("_t"))
    rows = rows.select("doc_id", F.col("_t.doc_tokens").alias("doc_tokens"), F.explode(F.arrays_zip(*[F.col(f"_t.{f}").alias(f) for f in fields])).alias("_p"))
    return rows.select("doc_id", *[F.col(f"_p.{f}").alias(f) for f in fields], "doc_tokens")


def combinations(total: int, depth: int, parts: list[int]) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` of ``parts`` that sum to ``total``."""
    allowed, out = set(parts), []

    def extend(left: int, most: int, taken: tuple[int, ...]) -> None:
        if left in allowed and left <= most:
            out.append((*taken, left))
        if len(taken) + 1 < depth:
            for part in parts:
                if part <= most and 0 < left - part <= part * (depth - len(taken) - 1):
                    extend(left - part, part, (*taken, part))

    extend(total, total, ())
    return sorted(set(out))


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """min |a x - b|, x >= 0, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = 1e-10 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(most):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        k = int(w.argmax()) if len(w) else 0
        if not len(w) or w[k] <= scale:
            break
        active[k] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / (x[at][bad] - s[bad] + 1e-300))
            x[at] += step * (s - x[at])
            drop = at[(x[at] <= 1e-12) & bad]
            if not len(drop):
                drop = at[bad]
            x[drop], active[drop] = 0, False
    return x


def plan(histogram: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) for a histogram of lengths in units; no combination asks for more pieces than there are."""
    sizes = sorted(u for u, n in histogram.items() if n)
    found = combinations(units, depth, sizes)
    if not found:
        return []
    place = {u: i for i, u in enumerate(sizes)}
    a = np.zeros((len(sizes), len(found)))
    for j, combo in enumerate(found):
        for u in combo:
            a[place[u], j] += 1
    have = np.array([histogram[u] for u in sizes], float)
    weight = np.sqrt(np.array(sizes, float))[:, None]  # a long piece left over costs more than a short one
    x = nnls(a * weight, have * weight[:, 0])
    left, out = have.astype(np.int64), []
    for j in np.argsort(-x, kind="stable"):
        most = min(int(left[place[u]] // found[j].count(u)) for u in found[j])
        times = min(int(np.floor(x[j] + 1e-9)), most)
        if times > 0:
            out.append((found[j], times))
            for u in found[j]:
                left[place[u]] -= times
    return out


def places(chosen: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, end rank, first sequence, slot): ranks of pieces of a size that go to a slot of consecutive sequences."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for combo, times in chosen:
        for slot, u in enumerate(combo):
            start = used.get(u, 0)
            out.append((u, start, start + times, sequence, slot))
            used[u] = start + times
        sequence += times
    return out


def _greedy(window: int):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        """First fit, longest pieces first, over the pieces of one group."""
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        free, sequence, offset = np.zeros(len(group), np.int64), [], []
        opened = 0
        for n in group["length"].to_numpy():
            fits = free[:opened] >= n
            k = int(fits.argmax()) if opened and fits.any() else opened
            if k == opened:
                free[k], opened = window, opened + 1
            sequence.append(k)
            offset.append(window - free[k])
            free[k] -= n
        return group.assign(sequence_id=_RESIDUAL + group["_group"].to_numpy(np.int64) * (1 << 20) + np.array(sequence, np.int64), offset=np.array(offset, np.int64)).drop(columns="_group")

    return fit


def pack(cut_pieces: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, seed: int = 13) -> DataFrame:
    """``cut_pieces`` with ``sequence_id`` and ``offset``.

    ``cut_pieces`` is read several times: pass a written table with doc_id, start, length,
    ids_crc32 (and what else shall come along). Repeated rows are pieces of their own; null
    ids are packed like others; no pieces give no rows."""
    sizes = F.when(F.col("length") % unit == 0, F.col("length") / F.lit(unit)).otherwise(0).cast("long")  # 0: what no whole units hold is packed greedily
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), "start", "length", "ids_crc32")
    n = buckets_for(cut_pieces.count())
    rows = cut_pieces.withColumns({"_size": sizes, "_hash": hashed, "_bucket": F.pmod(hashed, F.lit(n)), "_one": F.lit(1).cast("long")})
    totals = rows.groupBy("_size").agg(F.count(F.lit(1)), F.sum("length")).collect()  # at most window / unit rows
    histogram = {r[0]: r[1] for r in totals if r[0]}
    ranked = exclusive_prefix(rows, "_size", "_bucket", ["_hash", "doc_id", "start", "length", "ids_crc32"], "_one", "_rank")
    spots = places(plan(histogram, window // unit, depth))
    table_ = sorted(spots)
    kept = sum((end - start) * size * unit for size, start, end, _, _ in spots)
    groups = max(1, -(-(sum(r[2] for r in totals) - kept) // (GROUP * window)))
    lows = np.array([[u, start, end, sequence, slot] for u, start, end, sequence, slot in table_], np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence long, slot int")
    def spot(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = lows[:, 0] * (1 << 48) + lows[:, 1]
        at = np.searchsorted(key, size.to_numpy(np.int64) * (1 << 48) + rank.to_numpy(np.int64), side="right") - 1
        if not len(lows):
            return pd.DataFrame({"sequence": np.full(len(size), -1), "slot": np.full(len(size), -1, np.int32)})
        row = lows[np.maximum(at, 0)]
        ok = (at >= 0) & (row[:, 0] == size.to_numpy()) & (rank.to_numpy() < row[:, 2])
        return pd.DataFrame({"sequence": np.where(ok, row[:, 3] + rank.to_numpy() - row[:, 1], -1), "slot": np.where(ok, row[:, 4], -1).astype(np.int32)})

    placed = written(ranked.withColumn("_s", spot("_size", "_rank")).withColumns({"sequence_id": F.col("_s.sequence"), "_slot": F.col("_s.slot")}).drop("_size", "_bucket", "_one", "_rank", "_s"), "pieces-placed")
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    solved = placed.where("sequence_id >= 0").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_slot", "_hash")
    rest = placed.where("sequence_id < 0").withColumn("_group", F.pmod(F.col("_hash"), F.lit(groups))).drop("_slot", "_hash", "sequence_id")
    greedy = rest.groupBy("_group").applyInPandas(_greedy(window), solved.schema)
    return solved.unionByName(greedy)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and where they lie: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for."""
    out = pack(written(pieces(docs, path or vocabulary(), with_ids=with_ids), "pieces"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))
