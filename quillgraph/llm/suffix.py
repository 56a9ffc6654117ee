"""Repeated byte strings by suffix arrays.

Every byte goes that a string of ``length`` bytes covers which also starts in a
document with a smaller key.  Strings meet exactly, by sorting suffixes:

1. Texts are packed into rows of about a megabyte.  In every window of
   ``length`` bytes the half-length gram with the smallest hash is the anchor,
   so equal windows have equal anchors; a run of windows with one anchor is a
   segment of fewer than two lengths.
2. Anchor hashes, once for each pack, are exchanged; anchors of one document
   alone end here.
3. The segments of the others are dealt out by anchor, equal ones of a pack
   only once.  Where very many packs hold an anchor, its windows are dealt out
   one by one by their own hashes, so no anchor gathers in one task.
4. Each bucket sorts its suffixes in two stages: suffixes smaller than their
   successors directly, the others by a scan over the buckets of first bytes,
   which puts the predecessor of each suffix in place.  Neighbours with a
   common prefix of ``length`` bytes or more are equal windows; all but those
   of the smallest key are repeats.
5. The repeats return to their packs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_or_empty

LENGTH = 50
PACK_BYTES = 1 << 20
#: Text whose anchors one bucket takes; a bucket of segments takes a sixteenth.
BUCKET_BYTES = 16 << 20
#: An anchor that more packs hold is dealt out window by window.
MANY_PACKS = 4096
NULL_KEY = -(1 << 63)

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_SLICE = 1 << 20


# --- two-stage suffix sorting ---------------------------------------------------------------------------------------


def _words_at(padded: np.ndarray, at: np.ndarray, skip: int) -> np.ndarray:
    """Eight bytes from each place as big-endian numbers, so that they sort as bytes do."""
    view = np.ndarray(shape=(len(padded) - 7,), dtype=">u8", buffer=padded.data, strides=(1,))
    return view[at + skip].astype(np.uint64)


def _direct_sort(padded: np.ndarray, at: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in order of the following bytes, up to ``depth``; ties keep their order.

    Eight bytes at a time; after the first round only groups of equal suffixes
    are sorted further.  Bytes beyond a segment's end count as 0.
    """
    order, active = np.arange(len(at)), np.arange(len(at))
    group = np.zeros(len(at), dtype=np.int64)
    for skip in range(0, depth, 8):
        if not len(active):
            break
        chosen = order[active]
        words = _words_at(padded, at[chosen], skip)
        left = room[chosen] - skip
        short = left < 8
        if short.any():
            cut = np.clip(8 - left[short], 0, 8).astype(np.uint64) * np.uint64(8)
            words[short] = np.where(cut >= 64, np.uint64(0), (words[short] >> np.minimum(cut, 63)) << np.minimum(cut, 63))
        ranks = np.argsort(words, kind="stable") if skip == 0 else np.lexsort((words, group[active]))
        words = words[ranks]
        order[active] = chosen[ranks]
        # Groups are contiguous, so the sorted groups stand where they stood.
        starts = np.ones(len(active), dtype=bool)
        starts[1:] = (words[1:] != words[:-1]) | (group[active][1:] != group[active][:-1])
        ids = np.flatnonzero(starts)
        sizes = np.diff(np.append(ids, len(active)))
        group[active] = np.repeat(active[ids], sizes)
        active = active[np.repeat(sizes > 1, sizes)]
    return at[order]


def two_stage(text: np.ndarray, ends: np.ndarray, *, needed: np.ndarray | None = None, depth: int = 64) -> np.ndarray:
    """Suffixes of segments in order of their bytes: places in ``text``.

    ``ends`` are the ends of the segments, which no suffix passes; an ended
    suffix comes before a longer one.  Only ``needed`` places and those that
    inducing them takes are sorted, all by default.  The order is exact in the
    first ``depth`` bytes.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    lengths = np.diff(np.concatenate([[0], ends]))
    room = np.repeat(ends, lengths)
    room -= np.arange(n)  # bytes to the segment's end
    # Greater than the successor: the next different byte is smaller, or the segment ends.
    change = np.ones(n, dtype=bool)
    change[:-1] = (text[1:] != text[:-1]) | (room[:-1] == 1)
    turn = np.flatnonzero(change)
    falls = np.ones(len(turn), dtype=bool)
    inner = turn[room[turn] > 1]
    falls[room[turn] > 1] = text[inner] > text[inner + 1]
    sizes = np.diff(np.concatenate([[-1], turn]))
    falling = np.repeat(falls, sizes)
    wanted = np.ones(n, dtype=bool) if needed is None else needed.copy()
    # A falling suffix is induced from its successor, so that is wanted too.
    frontier = np.flatnonzero(wanted & falling & (room > 1))
    while needed is not None and len(frontier):
        following = frontier + 1
        following = following[~wanted[following]]
        wanted[following] = True
        frontier = following[falling[following] & (room[following] > 1)]
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
    rising = np.flatnonzero(wanted & ~falling)
    rising = _direct_sort(padded, rising, room[rising], depth)
    first = text[rising]
    bounds = np.searchsorted(first, np.arange(257)) if len(rising) else np.zeros(257, dtype=np.int64)
    begins = np.zeros(n, dtype=bool)
    begins[np.concatenate([[0], ends[:-1]])[lengths > 0]] = True
    induced = wanted & falling
    arrived: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(places: np.ndarray, above: int) -> None:
        """Falling suffixes go behind what their bucket already has."""
        byte = text[places]
        places, byte = places[byte > above], byte[byte > above]
        order = np.argsort(byte, kind="stable")
        places, byte = places[order], byte[order]
        cuts = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(places, cuts):
            if len(part):
                arrived[text[part[0]]].append(part)

    last = ends[lengths > 0] - 1
    deal(last[induced[last]], -1)
    out = []
    for byte in range(256):
        wave = np.concatenate(arrived[byte]) if arrived[byte] else np.empty(0, np.int64)
        falls_here = [wave]
        while len(wave):
            before = wave[~begins[wave]] - 1
            wave = before[induced[before] & (text[before] == byte)]
            falls_here.append(wave)
        here = np.concatenate([*falls_here, rising[bounds[byte] : bounds[byte + 1]]])
        out.append(here)
        before = here[~begins[here]] - 1
        before = before[induced[before]]
        if len(before):
            deal(before, byte)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Bytes, up to ``limit``, that each suffix shares with the one before it; all have ``limit`` bytes."""
    padded = np.concatenate([text, np.zeros(16, dtype=np.uint8)])
    out = np.zeros(len(order), dtype=np.int64)
    active = np.arange(1, len(order))
    for skip in range(0, limit, 8):
        differ = _words_at(padded, order[active], skip) ^ _words_at(padded, order[active - 1], skip)
        same = differ == 0
        part = differ[~same]
        lead = np.zeros(len(part), dtype=np.int64)
        for byte in range(8):  # leading bytes that agree
            lead += (part >> np.uint64(8 * (7 - byte))) == 0
        out[active[~same]] = np.minimum(skip + lead, limit)
        active = active[same]
    out[active] = limit
    return out


# --- anchors --------------------------------------------------------------------------------------------------------


def gram_hashes(padded: np.ndarray, at: np.ndarray | slice, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` bytes from each place; ``padded`` has eight bytes more."""
    view = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    total = None
    offsets = [*range(0, gram - 7, 8)]
    if offsets[-1] + 8 < gram:
        offsets.append(gram - 8)
    for i, skip in enumerate(offsets):
        words = view[skip + at.start : skip + at.stop] if isinstance(at, slice) else view[at + skip]
        words = words * np.uint64(_MIX[i % 4] + 2 * i)
        words ^= words >> np.uint64(29)
        total = words if total is None else (total * np.uint64(_MIX[3])) + words
    total ^= total >> np.uint64(32)
    total *= np.uint64(_MIX[2])
    total ^= total >> np.uint64(29)
    return total


def segments(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, anchor."""
    gram = length // 2
    width = length - gram + 1
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    firsts, lasts, anchors = [], [], []
    for begin, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        if end - begin >= length:
            firsts.append(begin)
            lasts.append(end - length)
    # Neighbouring texts are worked on together, up to a slice; windows across texts are dropped below.
    spans = np.array([firsts, lasts], dtype=np.int64).T
    valid_from, valid_to = (spans[:, 0], spans[:, 1]) if len(spans) else (np.empty(0, np.int64),) * 2
    out_first, out_last, out_anchor = [], [], []
    for low in range(0, max(len(text) - length + 1, 0), _SLICE):
        high = min(low + _SLICE, len(text) - length + 1)  # windows low .. high - 1
        h = gram_hashes(padded, slice(low, high + width - 1), gram)
        m, size = h, 1
        while 2 * size <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < width:
            m = np.minimum(m[: len(h) - width + 1], m[width - size :])
        n = high - low
        begins = np.zeros(n, dtype=bool)
        begins[0] = True
        begins[1:] = (h[: n - 1] == m[:-1]) | (h[width : width + n - 1] < m[:-1])
        a, b = np.searchsorted(valid_from, low), np.searchsorted(valid_from, high)
        begins[valid_from[a:b] - low] = True
        a, b = np.searchsorted(valid_to, low - 1), np.searchsorted(valid_to, high - 1)
        begins[valid_to[a:b] + 1 - low] = True
        first = np.flatnonzero(begins)
        last = np.append(first[1:], n) - 1
        owner = np.searchsorted(valid_from, first + low, side="right") - 1
        ok = (owner >= 0) & (first + low <= valid_to[owner]) if len(valid_to) else np.zeros(len(first), bool)
        first, last = first[ok], last[ok]
        anchor = last.copy()
        open_ = np.flatnonzero(h[last] != m[last])
        if len(open_):
            anchor[open_] = first[open_] + np.lib.stride_tricks.sliding_window_view(h, width)[first[open_]].argmin(axis=1)
        out_first.append(first + low)
        out_last.append(last + low)
        out_anchor.append(anchor + low)
    if not out_first:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(out_first), np.concatenate(out_last), np.concatenate(out_anchor)


# --- packs and buckets ----------------------------------------------------------------------------------------------


def _squeeze(values: np.ndarray | bytes) -> bytes:
    import zstandard

    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _open(blob: bytes, dtype: str = "u1") -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


_PACK = "_keys binary, _ends binary, _text binary, _firsts binary, _windows binary, _anchors binary, _bytes long"


def _packs(length: int):
    """Rows of about a megabyte of text with the segments of its windows."""
    from .common import by_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for read in batches:
            for batch in by_size(read, (1,), 1 << 16, PACK_BYTES):
                texts = [t.encode() for t in batch.column(1).to_pylist()]
                keys = np.asarray(batch.column(0).fill_null(NULL_KEY)).astype(np.int64)
                ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
                text = np.frombuffer(b"".join(texts), dtype=np.uint8)
                first, last, anchor = segments(text, ends, length)
                columns = [_squeeze(keys), _squeeze(ends), _squeeze(text), _squeeze(np.diff(first, prepend=0)), _squeeze((last - first + 1).astype(np.uint8)), _squeeze((anchor - first).astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.binary()) for c in columns), pa.array([int(ends[-1]) if len(ends) else 0])], names=[c.split()[0] for c in _PACK.split(", ")])

    return run


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one at a time, so that one pack is open at once."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


class _Pack:
    """A pack's arrays: keys, ends, text, and of its segments first window, windows, anchor hash and owner's key."""

    def __init__(self, row: dict, length: int):
        self.keys, self.ends, self.text = _open(row["_keys"], "i8"), _open(row["_ends"], "i8"), _open(row["_text"])
        self.first = np.cumsum(_open(row["_firsts"], "i8"))
        self.windows = _open(row["_windows"]).astype(np.int64)
        anchor = self.first + _open(row["_anchors"])
        padded = np.concatenate([self.text, np.zeros(8, dtype=np.uint8)])
        # Anchors have small hashes, as the smallest of their windows; multiplied once more they spread over all buckets.
        hashes = gram_hashes(padded, anchor, length // 2) * np.uint64(_MIX[0]) if len(anchor) else np.empty(0, np.uint64)
        self.hashes = hashes ^ (hashes >> np.uint64(32))
        self.of = np.searchsorted(self.ends, self.first, side="right")  # an empty text ends where it begins and owns nothing
        self.owner = self.keys[self.of] if len(anchor) else np.empty(0, np.int64)

    def unique(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted anchor hashes without their last bit, segment to hash, and whether several keys have the hash."""
        values, back = np.unique(self.hashes >> np.uint64(1), return_inverse=True)
        least, most = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), NULL_KEY)
        np.minimum.at(least, back, self.owner)
        np.maximum.at(most, back, self.owner)
        return values, back, least < most


def _bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Buckets by the leading bits of 63-bit hashes, ascending with them."""
    return ((hashes >> np.uint64(31)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _anchor_rows(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                values, _, several = _Pack(row, length).unique()
                bucket = _bucket_of(values, buckets)
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                # The bucket has the leading bits; of the others 39, and the mark, make five bytes.
                coded = ((values << np.uint64(1)) | several.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :5]
                parts = [(int(bucket[a]), coded[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int64()), pa.array([row["_pack"]] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary())], names=["_bucket", "_pack", "_hashes"])

    return run


def _shared(many: int):
    """For each anchor hash of a bucket: 0 one document's alone, 1 shared, 2 shared by many packs."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, dtype=np.uint8).reshape(-1, 5) for b in table.column("_hashes").to_pylist()]
        coded = np.pad(np.concatenate(parts), ((0, 0), (0, 3))).view(np.uint64)[:, 0]
        _, back, count = np.unique(coded >> np.uint64(1), return_inverse=True, return_counts=True)
        several = np.bincount(back, weights=(coded & np.uint64(1)).astype(float)) > 0
        kind = ((count > 1) | several).astype(np.uint8) + (count > many)
        flags = np.split(kind[back].astype(np.uint8), np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"_bucket": table.column("_bucket"), "_pack": table.column("_pack"), "_flags": pa.array([_squeeze(f) for f in flags], pa.binary())})

    return run


_DEALT = "_bucket long, _pack long, _at binary, _owners binary, _sizes binary, _bytes_of binary"


def _segment_rows(length: int, buckets: int):
    """Shared segments by bucket, equal ones of a pack once; in a row of its own where the pack's other copies are.

    The row of a bucket has places, owners, numbers of windows and the bytes;
    the pack's own row (a negative bucket) the places of the copies and of the
    segment that each equals, or the windows of a copy that surely repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                pack = _Pack(row, length)
                values, back, _ = pack.unique()
                flags = np.concatenate([np.empty(0, np.uint8), *(_open(f["_flags"]) for f in sorted(row["_of_pack"] or [], key=lambda f: f["_bucket"]))])
                kind = flags[back]
                pick = np.flatnonzero(kind == 1)
                first, size, owner, spread = pack.first[pick], pack.windows[pick], pack.owner[pick], pack.hashes[pick] >> np.uint64(1)
                single = np.flatnonzero(kind == 2)
                if len(single):  # windows one by one
                    n = pack.windows[single]
                    at = np.repeat(pack.first[single], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    padded = np.concatenate([pack.text, np.zeros(8, dtype=np.uint8)])
                    first, size = np.concatenate([first, at]), np.concatenate([size, np.ones(len(at), np.int64)])
                    owner = np.concatenate([owner, np.repeat(pack.owner[single], n)])
                    spread = np.concatenate([spread, gram_hashes(padded, at, length) >> np.uint64(1)])
                order = np.lexsort((first, owner))  # the smallest key first
                raw, known = pack.text.tobytes(), {}
                chosen, copy, original = [], [], []
                for i, a, n in zip(order.tolist(), first[order].tolist(), size[order].tolist(), strict=True):
                    j = known.setdefault(raw[a : a + n + length - 1], i)
                    if i == j:
                        chosen.append(i)
                    else:
                        copy.append(i)
                        original.append(j)
                chosen, copy, original = (np.array(x, dtype=np.int64) for x in (chosen, copy, original))
                bucket = _bucket_of(spread[chosen], buckets)
                by_bucket = np.argsort(bucket, kind="stable")
                chosen, bucket = chosen[by_bucket], bucket[by_bucket]
                cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
                out = []
                for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    part = chosen[low:high]
                    body = b"".join([raw[a : a + n + length - 1] for a, n in zip(first[part].tolist(), size[part].tolist(), strict=True)])
                    out.append((int(bucket[low]), row["_pack"], first[part].tobytes(), owner[part].tobytes(), size[part].astype(np.uint8).tobytes(), _squeeze(body)))
                later = owner[copy] > owner[original]
                out.append((-1 - row["_pack"] % buckets, row["_pack"], first[copy].tobytes(), np.where(later, -1, first[original]).tobytes(), size[copy].astype(np.uint8).tobytes(), b""))
                names = [c.split()[0] for c in _DEALT.split(", ")]
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def repeated_windows(bodies: list[bytes], owners: np.ndarray, length: int) -> list[int]:
    """For each segment the windows, as bits, that a segment of a smaller owner also has."""
    known: dict[bytes, int] = {}
    which = np.fromiter((known.setdefault(b, len(known)) for b in bodies), dtype=np.int64, count=len(bodies))
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, which, owners)
    sizes = np.fromiter((len(b) for b in known), dtype=np.int64, count=len(known))
    text, ends = np.frombuffer(b"".join(known), dtype=np.uint8), np.cumsum(sizes)
    begins = ends - sizes
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(known), dtype=np.int32), sizes)
    window = np.arange(len(text), dtype=np.int32) <= (ends - length).astype(np.int32)[of]
    order = two_stage(text, ends, needed=window, depth=length + 6)
    order = order[window[order]]
    alike = common_prefixes(text, order, length) >= length
    heads = np.flatnonzero(~alike)
    low = np.repeat(np.minimum.reduceat(least[of[order]], heads), np.diff(np.append(heads, len(order))))
    again = order[low < least[of[order]]]
    masks = np.zeros(len(known), dtype=np.int64)
    np.bitwise_or.at(masks, of[again], np.int64(1) << (again - begins[of[again]]))
    full = (np.int64(1) << windows) - 1
    return np.where(owners > least[which], full[which], masks[which])


def _sorted_bucket(length: int):
    def run(table: pa.Table) -> pa.Table:
        packs, at, masks, links = [], [], [], []
        if table.column("_bucket")[0].as_py() < 0:
            for row in table.to_pylist():
                first, original = np.frombuffer(row["_at"], dtype=np.int64), np.frombuffer(row["_owners"], dtype=np.int64)
                full = (np.int64(1) << np.frombuffer(row["_sizes"], dtype=np.uint8).astype(np.int64)) - 1
                packs.append(row["_pack"])
                at.append(first.tobytes())
                masks.append(np.where(original < 0, full, 0).tobytes())
                links.append(original.tobytes())
        else:
            rows = table.to_pylist()
            bodies, counts = [], []
            for row in rows:
                raw = _open(row["_bytes_of"]).tobytes()
                stops = np.cumsum(np.frombuffer(row["_sizes"], dtype=np.uint8).astype(np.int64) + length - 1).tolist()
                bodies += [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
                counts.append(len(stops))
            owners = np.concatenate([np.frombuffer(r["_owners"], dtype=np.int64) for r in rows])
            found = np.split(repeated_windows(bodies, owners, length), np.cumsum(counts)[:-1])
            for row, mask in zip(rows, found, strict=True):
                first, hit = np.frombuffer(row["_at"], dtype=np.int64), mask != 0
                if hit.any():
                    packs.append(row["_pack"])
                    at.append(first[hit].tobytes())
                    masks.append(mask[hit].tobytes())
                    links.append(b"")
        return pa.table({"_pack": pa.array(packs, pa.int64()), "_at": pa.array(at, pa.binary()), "_masks": pa.array(masks, pa.binary()), "_links": pa.array(links, pa.binary())})

    return run


def _covered(row: dict, size: int, length: int) -> np.ndarray:
    """Bytes of a pack that a repeated window covers."""
    found = row["_repeats"] or []
    join = lambda name, of: np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r[name], dtype=np.int64) for r in of)])
    at, masks = join("_at", found), join("_masks", found)
    local = [r for r in found if r["_links"]]
    copies, originals = join("_at", local), join("_links", local)
    linked = originals >= 0
    if linked.any():  # copies within one document fare as the first of them
        order = np.argsort(at[masks != 0], kind="stable")
        places, values = at[masks != 0][order], masks[masks != 0][order]
        spot = np.minimum(np.searchsorted(places, originals[linked]), max(len(places) - 1, 0))
        hit = places[spot] == originals[linked] if len(places) else np.zeros(int(linked.sum()), bool)
        at = np.concatenate([at, copies[linked][hit]])
        masks = np.concatenate([masks, values[spot[hit]] if len(places) else np.empty(0, np.int64)])
    edges = np.zeros(size + 1, dtype=np.int32)
    for bit in range(int(masks.max(initial=0)).bit_length()):
        starts = at[(masks >> bit) & 1 == 1] + bit
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeated_bytes(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, many: int = MANY_PACKS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``key, n_bytes, spans, kept`` of every row: the removed runs (start, stop) and the remaining bytes, in UTF-8.

    ``length`` lies between 16 and 62.  A null or empty text has no bytes;
    rows with one key count as one document, so what only they share stays; a
    null key comes before all others; other columns, whatever their names, are
    not read; an empty table gives an empty result.  Very long texts are taken
    whole.  Keys are integers.
    """
    if not 16 <= length <= 62:
        raise ValueError("length: 16 to 62")
    rows = docs.select(F.col(key).cast("long").alias("_key"), text_or_empty(text).alias("_text"))
    packs = materialize(rows.mapInArrow(_packs(length), _PACK).withColumn("_pack", F.monotonically_increasing_id()), "packs")
    total = packs.agg(F.sum("_bytes")).first()[0] or 0
    packs = packs.drop("_bytes")
    coarse = -(-total // bucket_bytes) + 1
    fine = -(-total * 16 // bucket_bytes) + 1
    anchors = packs.mapInArrow(_anchor_rows(length, coarse), "_bucket long, _pack long, _hashes binary")
    flags = anchors.groupBy("_bucket").applyInArrow(_shared(many), "_bucket long, _pack long, _flags binary")
    of_pack = flags.groupBy("_pack").agg(F.collect_list(F.struct("_bucket", "_flags")).alias("_of_pack"))  # the anchors of one pack
    # Both joins take the packs whole and keep all, so that Spark exchanges them once.
    dealt = packs.join(of_pack, "_pack", "left").mapInArrow(_segment_rows(length, fine), _DEALT)
    repeats = dealt.groupBy("_bucket").applyInArrow(_sorted_bucket(length), "_pack long, _at binary, _masks binary, _links binary")
    back = repeats.groupBy("_pack").agg(F.collect_list(F.struct("_at", "_masks", "_links")).alias("_repeats"))  # the segments of one pack
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                keys, ends, body = _open(row["_keys"], "i8"), _open(row["_ends"], "i8"), _open(row["_text"])
                gone = _covered(row, len(body), length)
                spans, kept = [], []
                for low, high in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    part = gone[low:high]
                    edge = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": a, "stop": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    kept.append(body[low:high][~part].tobytes())
                names = pa.array(keys.tolist(), pa.int64(), mask=keys == NULL_KEY)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(ends, prepend=0)), pa.array(spans, span), pa.array(kept, pa.binary())], names=["_key", "n_bytes", "spans", "kept"])

    result = T.StructType([T.StructField("_key", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept", T.BinaryType())])
    return packs.join(back, "_pack", "left").mapInArrow(finish, result).withColumnRenamed("_key", key)


def oracle_sql(length: int = LENGTH) -> str:
    """The registered query in DuckDB SQL: every string of ``length`` bytes is a row, in hexadecimal digits.

    Texts are cut into pieces that overlap, as ``substr`` reads a string from its beginning.
    """
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range(0, n, 500)) AS base, x FROM d WHERE n >= {length}),
q AS (SELECT doc_id, n, base, substr(x, 2 * base + 1, {1000 + 2 * length}) AS y FROM c),
p AS (SELECT doc_id, base, unnest(range(least(500, n - base - {length - 1}))) AS i, y FROM q),
w AS (SELECT doc_id, base + i AS i, min(doc_id) OVER (PARTITION BY substr(y, 2 * i + 1, {2 * length})) AS first FROM p),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE first < doc_id),
s AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
g AS (SELECT doc_id, run, min(i) AS a, max(i) + {length} AS b FROM s GROUP BY ALL),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS froms, list(b ORDER BY a) AS stops FROM g GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN froms IS NULL THEN x ELSE array_to_string(list_transform(range(len(froms) + 1), lambda q: substr(x, 2 * coalesce(stops[q], 0) + 1, 2 * (coalesce(froms[q + 1], d.n) - coalesce(stops[q], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
