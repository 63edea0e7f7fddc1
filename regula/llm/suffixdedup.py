"""Removal of passages that an earlier document holds, byte by byte, with
suffix arrays.

A byte goes if a string of ``SPAN`` bytes covers it that also starts in a
document with a smaller id.  All such strings are compared, none is sampled:

1. Documents are dealt into shards by a hash of their id (one shuffle of the
   texts, read again by later steps).
2. The minimiser of a string is the least hash of its ``ANCHOR``-byte
   substrings.  Neighbouring strings with one minimiser form a run, a stretch
   of at most ``SPAN + MAX_RUN - 1`` bytes.  Equal strings have equal
   minimisers, so a run whose minimiser occurs in one document only holds
   nothing shared; shards send their distinct minimisers to be counted, and
   get back one bit for each.
3. The distinct runs left over, with the least document that holds each, go to
   the part their minimiser belongs to.  Equal strings meet in one part.
   There the runs of all shards are placed in one sorted table by binary
   search, their bytes get a suffix array by Larsson-Sadakane refinement and
   common prefixes by Kasai's walk, and every group of suffixes with ``SPAN``
   bytes in common gives its least document to each of its strings.
4. The answers go back to the shards, which cut the bytes.

Parts are bounded by the corpus size over their number; copies, however many,
reach a part once from each shard.  What is shuffled is packed bytes.  Runs are
told apart by 64-bit hashes.

Defined results: a null text counts as empty (0 bytes, digest of nothing); a
document shorter than ``SPAN`` bytes keeps all; rows that share an id do not
cut each other; a row without id comes after all ids, and such rows do not cut
each other; an empty table gives an empty table; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regula.llm.text import mix, span_hashes, text_bytes

SPAN = 50
ANCHOR = 24
MAX_RUN = 64
SHARD_BYTES = 12 << 20
PART_BYTES = 4 << 20
SLICE = 2 << 20
_LAST = 2**63 - 1
_U = np.uint64


# ---------------------------------------------------------------- suffix arrays

def words_at(data: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8" if big else "<u8", padded.data, strides=(1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes (at least), and the
    rank of each position.  Larsson-Sadakane: suffixes sorted by h bytes are
    sorted by 2h through the rank of what follows, and only those in groups of
    several are moved."""
    n = len(data)
    key = words_at(data, big=True)
    order = np.argsort(key, kind="stable")
    ranks = _group_ranks(key[order], np.arange(n), order, np.empty(n + 1, np.int64))
    ranks[n] = -1
    h = 8
    while h < depth and n:
        sizes = np.bincount(ranks[:n], minlength=n)
        places = np.flatnonzero(sizes[ranks[order]] > 1)
        if not len(places):
            break
        move = order[places]
        follow = ranks[np.minimum(move + h, n)]
        pair = (ranks[move].astype(_U) << _U(32)) | (follow + 1).astype(_U)
        by = np.argsort(pair, kind="stable")
        order[places] = move[by]
        ranks = _group_ranks(pair[by], places, move[by], ranks)
        h *= 2
    return order, ranks[:n]


def _group_ranks(keys: np.ndarray, places: np.ndarray, positions: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Give each position the place of its group's first member."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    ranks[positions] = places[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(keys) else 0
    return ranks


def kasai(data: np.ndarray, order: np.ndarray, starts: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, up to ``limit`` bytes, of each listed suffix with the one
    before it in ``order``.  The listed suffixes are stretches (start, count)
    of the text.  Kasai: one position further the prefix is at most one byte
    shorter, as long as the suffix after the neighbour is listed and still in
    front; all stretches walk abreast."""
    lcp = np.zeros(len(order), np.int64)
    place = np.full(len(data) + 1, -1)
    place[order] = np.arange(len(order))
    words = words_at(np.concatenate([data, np.zeros(limit + 8, np.uint8)]))
    at, left, h = starts.copy(), counts.copy(), np.zeros(len(starts), np.int64)
    while len(at):
        mine = place[at]
        before = order[np.maximum(mine - 1, 0)]
        open_ = np.flatnonzero((mine > 0) & (h < limit))
        while len(open_):
            differ = words[at[open_] + h[open_]] ^ words[before[open_] + h[open_]]
            low = differ & (~differ + _U(1))
            equal = np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            h[open_] += equal
            open_ = open_[(equal == 8) & (h[open_] < limit)]
        h = np.where(mine > 0, np.minimum(h, limit), 0)
        lcp[mine] = h
        go = left > 1
        at, left, h, after = at[go] + 1, left[go] - 1, h[go], place[before[go] + 1]
        h = np.where((after >= 0) & (after < place[at]), np.maximum(h - 1, 0), 0)
    return lcp


# ---------------------------------------------------------------- runs of a shard

def find_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, start, number of strings and minimiser of each run of the texts."""
    n = len(data)
    whole = np.flatnonzero(np.diff(offsets) >= SPAN)
    if not len(whole):
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, _U)
    words = words_at(np.concatenate([data, np.zeros(ANCHOR, np.uint8)]))
    h = words[:n] * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h += words[8:n + 8] * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(31)
    h += words[16:n + 16] * _U(0x165667B19E3779F9)
    h = mix(h)
    for step in (1, 2, 4, 8, SPAN - ANCHOR + 1 - 16):  # least of 2, 4, 8, 16 and then all
        h = np.minimum(h[:-step], h[step:])
    valid = np.zeros(len(h) + 1, bool)
    for r in whole:
        valid[offsets[r]:offsets[r + 1] - SPAN + 1] = True
    valid = valid[:len(h)]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (h[1:] != h[:-1])
    starts = np.flatnonzero(new)
    spots = np.flatnonzero(valid)
    counts = np.diff(np.append(np.searchsorted(spots, starts), len(spots)))
    pieces = -(-counts // MAX_RUN)
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + inner * MAX_RUN
    counts = np.minimum(np.repeat(counts, pieces) - inner * MAX_RUN, MAX_RUN)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, starts, counts, h[starts]


class Shard:
    """The texts of one shard and their runs, found slice by slice."""

    def __init__(self, table: pa.Table, parts: int):
        self.data, self.offsets = text_bytes(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
        self.ids = table.column("did").to_numpy()
        found, row = [], 0
        while row < len(self.ids):
            stop = max(row + 1, int(np.searchsorted(self.offsets, self.offsets[row] + SLICE, side="right")) - 1)
            lo, hi = self.offsets[row], self.offsets[stop]
            data = self.data[lo:hi]
            rows, starts, counts, least = find_runs(data, self.offsets[row:stop + 1] - lo)
            hashes = span_hashes(data, starts, starts + counts + SPAN - 1)
            found.append((rows + row, starts + lo, counts, least, hashes))
            row = stop
        cat = lambda i, t: np.concatenate([f[i] for f in found]).astype(t) if found else np.empty(0, t)
        self.rows, self.starts, self.counts = (cat(i, np.int64) for i in range(3))
        least, self.hashes = cat(3, _U), cat(4, _U)
        # a minimiser is known by its part and 40 more bits: it only filters
        self.codes = ((least & _U(0xFFFFFF)) % _U(parts) << _U(40)) | (least >> _U(24))

    def minimisers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes in order; whether several documents hold them."""
        docs = self.ids[self.rows]
        order = np.lexsort((docs, self.codes))
        codes, docs = self.codes[order], docs[order]
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        other = np.zeros(len(codes), bool)
        other[1:] = ~new[1:] & (docs[1:] != docs[:-1])
        first = np.flatnonzero(new)
        return codes[first], np.add.reduceat(other, first) > 0 if len(first) else np.empty(0, bool)


def _by_part(codes: np.ndarray):
    """(part, from, to) of each part in sorted codes."""
    parts = (codes >> _U(40)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(parts, prepend=-1))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(parts))):
        yield int(parts[lo]), int(lo), int(hi)


def _pack5(codes: np.ndarray) -> bytes:
    return codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack5(blob: bytes) -> np.ndarray:
    raw = np.zeros((len(blob) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return raw.view("<u8").ravel()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return data[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _rows(names: str, rows: list[tuple], kinds: tuple) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names.split())


_INT, _BIN = pa.int64(), pa.binary()


# ---------------------------------------------------------------- steps

def _send_minimisers(parts: int):
    def step(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        codes, several = Shard(table, parts).minimisers()
        return _rows("part shard codes several", [(p, shard, _pack5(codes[lo:hi]), _bits(several[lo:hi])) for p, lo, hi in _by_part(codes)],
                     (_INT, _INT, _BIN, _BIN))
    return step


def _count_minimisers(table: pa.Table) -> pa.Table:
    """For each shard's list, which minimisers several documents hold."""
    lists = [_unpack5(b) for b in table.column("codes").to_pylist()]
    several = np.concatenate([_flags(b, len(c)) for b, c in zip(table.column("several").to_pylist(), lists)])
    codes = np.concatenate(lists)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    shared = several[order]
    same = ranked[1:] == ranked[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    # several documents of one shard make it shared for a shard that has one, too:
    # then at least two entries are equal, which the lines above see
    out = np.empty(len(codes), bool)
    out[order] = shared
    ends = np.cumsum([len(c) for c in lists])
    parts, shards = table.column("part").to_pylist(), table.column("shard").to_pylist()
    return _rows("part shard shared", [(p, s, _bits(out[e - len(c):e])) for p, s, c, e in zip(parts, shards, lists, ends)], (_INT, _INT, _BIN))


def _send_runs(parts: int):
    def step(docs: pa.Table, marks: pa.Table) -> pa.Table:
        kinds = (_INT, _INT, _BIN, _BIN, _BIN, _BIN)
        names = "part shard counts least several bytes"
        if not docs.num_rows:
            return _rows(names, [], kinds)
        number = docs.column("shard")[0].as_py()
        shard = Shard(docs, parts)
        codes, _ = shard.minimisers()
        marked = dict(zip(marks.column("part").to_pylist(), marks.column("shared").to_pylist()))
        shared = np.zeros(len(codes), bool)
        for p, lo, hi in _by_part(codes):
            shared[lo:hi] = _flags(marked[p], hi - lo)
        take = np.flatnonzero(shared[np.searchsorted(codes, shard.codes)]) if len(codes) else np.empty(0, np.int64)
        part, hashes, docs_of = shard.codes[take] >> _U(40), shard.hashes[take], shard.ids[shard.rows[take]]
        order = np.lexsort((docs_of, hashes, part))
        take, part, hashes, docs_of = take[order], part[order], hashes[order], docs_of[order]
        new = np.ones(len(take), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (part[1:] != part[:-1])
        other = np.zeros(len(take), bool)
        other[1:] = ~new[1:] & (docs_of[1:] != docs_of[:-1])
        first = np.flatnonzero(new)
        several = np.add.reduceat(other, first) > 0 if len(first) else np.empty(0, bool)
        take, least, part = take[first], docs_of[first], part[first]
        rows = []
        for p, lo, hi in _by_part(part << _U(40)):
            counts = shard.counts[take[lo:hi]]
            rows.append((p, number, counts.astype(np.uint8).tobytes(), least[lo:hi].tobytes(), _bits(several[lo:hi]),
                         _gather(shard.data, shard.starts[take[lo:hi]], counts + SPAN - 1).tobytes()))
        return _rows(names, rows, kinds)
    return step


def _least_documents(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every string of the runs, back to back: the least document that
    holds it anywhere in this part."""
    order, _ = suffix_array(data, SPAN)
    whole = np.zeros(len(data), bool)
    spots = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    whole[spots] = True
    order = order[whole[order]]
    lcp = kasai(data, order, starts, counts, SPAN)
    owner = np.empty(len(data), np.int64)
    owner[spots] = np.repeat(least, counts)
    first = np.flatnonzero(lcp < SPAN)
    low = np.minimum.reduceat(owner[order], first)
    out = np.empty(len(data), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return out[spots]


def _match_runs(table: pa.Table) -> pa.Table:
    """Where a shard's run has strings held by a smaller document than one of
    the shard's own, its hash and the least document of its strings."""
    kinds = (_INT, _BIN, _BIN, _BIN, _BIN)
    lists = []
    for counts, least, several, raw in zip(*(table.column(c).to_pylist() for c in ("counts", "least", "several", "bytes"))):
        counts = np.frombuffer(counts, np.uint8).astype(np.int64)
        data = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(counts + SPAN - 1)
        hashes = span_hashes(data, ends - (counts + SPAN - 1), ends)
        lists.append((counts, np.frombuffer(least, np.int64), _flags(several, len(counts)), data, ends, hashes))
    # each shard's list is in order; its place in the merged table by binary search
    merged = np.unique(np.concatenate([x[5] for x in lists]))
    n_counts, n_least = np.zeros(len(merged), np.int64), np.full(len(merged), _LAST)
    places, pieces, where = [], [], np.full(len(merged), -1)
    size = 0
    for counts, least, _, data, ends, hashes in lists:
        at = np.searchsorted(merged, hashes)
        places.append(at)
        np.minimum.at(n_least, at, least)
        fresh = where[at] < 0
        lengths = counts[fresh] + SPAN - 1
        where[at[fresh]] = size + np.cumsum(lengths) - lengths
        n_counts[at[fresh]] = counts[fresh]
        pieces.append(_gather(data, (ends - (counts + SPAN - 1))[fresh], lengths))
        size += int(lengths.sum())
    data = np.concatenate(pieces)
    # the order of bytes, not of hashes
    by = np.argsort(where)
    low = np.empty(int(n_counts.sum()), np.int64)
    found = _least_documents(data, where[by], n_counts[by], n_least[by])
    begins = np.cumsum(n_counts) - n_counts
    low[np.repeat(begins[by] - (np.cumsum(n_counts[by]) - n_counts[by]), n_counts[by]) + np.arange(len(found))] = found
    lowest = np.minimum.reduceat(low, begins)
    even = np.maximum.reduceat(low, begins) == lowest
    rows = []
    for number, (counts, least, several, _, _, hashes), at in zip(table.column("shard").to_pylist(), lists, places):
        use = (lowest[at] < least) | several
        at, hashes = at[use], hashes[use]
        odd = at[~even[at]]
        rest = _gather(low, begins[odd], n_counts[odd]) if len(odd) else np.empty(0, np.int64)
        rows.append((number, hashes.tobytes(), lowest[at].tobytes(), _bits(even[at]), rest.tobytes()))
    return _rows("shard hashes lowest even rest", rows, kinds)


def _cut(parts: int, with_text: bool):
    def step(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = "doc_id n_bytes n_removed n_spans kept_sha256" + (" kept" if with_text else "")
        kinds = (_INT, _INT, _INT, _INT, pa.string(), *((pa.string(),) if with_text else ()))
        if not docs.num_rows:
            return _rows(names, [], kinds)
        shard = Shard(docs, parts)
        gone = np.zeros(len(shard.data) + 1, np.int64)
        got = [[np.frombuffer(b, t) for b in answers.column(c).to_pylist()]
               for c, t in (("hashes", _U), ("lowest", np.int64), ("rest", np.int64))]
        if answers.num_rows:
            hashes = np.concatenate(got[0])
            lowest, rest = np.concatenate(got[1]), np.concatenate([np.append(r, _LAST) for r in got[2]])
            even = np.concatenate([_flags(b, len(h)) for b, h in zip(answers.column("even").to_pylist(), got[0])])
            order = np.argsort(hashes, kind="stable")
            at = np.minimum(np.searchsorted(hashes[order], shard.hashes), max(len(order) - 1, 0)) if len(order) else None
            if at is not None:
                runs = np.flatnonzero(hashes[order][at] == shard.hashes)
                entry = order[at[runs]]
                own = shard.ids[shard.rows[runs]]
                # runs whose strings all have one least document
                flat = even[entry] & (lowest[entry] < own)
                starts, ends = shard.starts[runs[flat]], shard.starts[runs[flat]] + shard.counts[runs[flat]] + SPAN - 1
                np.add.at(gone, starts, 1)
                np.add.at(gone, ends, -1)
                # the others, string by string; their answers follow in entry order
                lengths = np.zeros(len(hashes), np.int64)
                lengths[entry] = np.where(even[entry], 0, shard.counts[runs])
                sizes = [len(h) for h in got[0]]
                base = np.repeat(np.cumsum([0, *[len(r) + 1 for r in got[2]]])[:-1], sizes)
                inner = np.cumsum(lengths) - lengths
                begin = np.repeat(inner[np.minimum(np.cumsum([0, *sizes])[:-1], len(inner) - 1)], sizes)
                odd = ~even[entry]
                runs, entry, own = runs[odd], entry[odd], own[odd]
                counts = shard.counts[runs]
                step_in = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                low = rest[np.repeat(base[entry] + inner[entry] - begin[entry], counts) + step_in]
                spots = (np.repeat(shard.starts[runs], counts) + step_in)[low < np.repeat(own, counts)]
                np.add.at(gone, spots, 1)
                np.add.at(gone, spots + SPAN, -1)
        gone = np.cumsum(gone)[:-1] > 0
        rows = []
        for i, doc in enumerate(docs.column("doc_id").to_pylist()):
            lo, hi = shard.offsets[i], shard.offsets[i + 1]
            out = gone[lo:hi]
            kept = shard.data[lo:hi][~out].tobytes()
            spans = int(np.count_nonzero(np.diff(np.concatenate([[False], out]).astype(np.int8)) == 1))
            rows.append((doc, int(hi - lo), int(out.sum()), spans, hashlib.sha256(kept).hexdigest(),
                         *((kept.decode(errors="replace"),) if with_text else ())))
        return _rows(names, rows, kinds)
    return step


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, with
    ``with_text``, the text left; a character cut in half becomes U+FFFD)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    parts = max(1, -(-total // PART_BYTES))
    dealt = texts.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("did"), "text",
                         F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(_LAST))), F.lit(shards)).alias("shard"))
    by_shard = dealt.repartition(shards, "shard").groupBy("shard")
    sent = by_shard.applyInArrow(_send_minimisers(parts), "part bigint, shard bigint, codes binary, several binary")
    marks = sent.groupBy("part").applyInArrow(_count_minimisers, "part bigint, shard bigint, shared binary")
    runs = by_shard.cogroup(marks.groupBy("shard")).applyInArrow(
        _send_runs(parts), "part bigint, shard bigint, counts binary, least binary, several binary, bytes binary")
    answers = runs.groupBy("part").applyInArrow(_match_runs, "shard bigint, hashes binary, lowest binary, even binary, rest binary")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept string" if with_text else "")
    return by_shard.cogroup(answers.groupBy("shard")).applyInArrow(_cut(parts, with_text), schema)
