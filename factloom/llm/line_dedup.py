"""Line deduplication: lines whose byte shingles are at least 80 % alike are one line, and one occurrence of it stays.

A line is a part of a text between line feeds; it is compared after lower-casing A-Z and collapsing white space. Lines of min_chars bytes or more take
part: the queries pass 1, so that every line that is not blank does; by default (MIN_CHARS) shorter ones stay. Equal lines collapse first (128-bit hash). Distinct lines then link where 80 % of their shingles are common:
lines of SHORT_SHINGLE to SHORT_CHARS bytes by 4-byte shingles, lines of LONG_CHARS bytes or more by 8-byte ones (those between take part in both,
so that lines on either side of a limit still meet). Under SHORT_SHINGLE bytes only equal lines are one.

Short lines are signed by SHORT_BANDS x SHORT_ROWS universal hash minima (24 x 5: a pair at the threshold is missed with probability 7e-5). A long
line's shingles are hashed once and dealt into 64 bins, whose minima are its signature (an empty bin takes the minimum of another bin, chosen by
hash): 16 bands of 4, 2e-4. Bands find candidates, the full shingle sets confirm them, and connected components give the groups. Of each group
the occurrence with the smallest (doc_id, line number) stays.

One pass over the texts hashes every line and signs each distinct one; occurrences and band entries then share one shuffle, in which equal bands meet.
A second pass hashes the lines again and brings those that may be candidates by a bit filter.

Edge cases. Null and empty texts have no lines to remove; blank lines stay. A group's other lines are removed from documents with their line feed; a document may become
empty and stays as a row. Rows that repeat a doc_id share their line numbers: both lose the numbers that either has to lose, so that of tied
occurrences (same doc_id, same number) all stay. Rows without doc_id neither lose lines nor take any from others. An empty table gives an empty
result. Texts of any length are used whole; other columns are carried through, and own ones called n_lines, n_removed or places become own_<name>.
Distinct lines are told apart by 128 bits where equal lines are removed and by 64 where links are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMO_WORDS, column_of, durable, mix, release, texts_of
from .linking import FLUSH, broadcast_if_few, connected_components, counted, dealt, fine_parts, link, met, rows_of

PERCENT, MIN_CHARS = 80, 40
LONG_CHARS, SHINGLE, BINS, BANDS = 72, 8, 64, 16
SHORT_CHARS, SHORT_SHINGLE, SHORT_BANDS, SHORT_ROWS = 96, 4, 24, 5
#: Bits for each candidate line in the filter by which a pass over the texts finds them: with two set for each, up to 1.4 % of the other lines pass too.
FILTER_BITS = 16
#: A line's node for its short shingles is its hash with these bits turned.
_TURN = 0x5851F42D4C957F2D
_BASE = 0x9E3779B97F4A7C15
_NONE = np.iinfo(np.uint64).max
_rng = np.random.default_rng(20_409)
#: The bins from which an empty one may borrow, one after the other.
_BORROW = _rng.integers(0, BINS, (BINS, BINS))
#: x -> a x + b mod 2**32 with odd a.
_A = _rng.integers(0, 2**31, SHORT_BANDS * SHORT_ROWS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, SHORT_BANDS * SHORT_ROWS, dtype=np.uint64).astype(np.uint32)


def normal(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def lines_of(text: bytes, min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, normal form) of the lines that take part; blank ones never do."""
    low = max(1, min_chars)
    return [(i, n) for i, line in enumerate(text.split(b"\n")) if len(n := normal(line)) >= low]


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """Hashes of all `shingle` consecutive bytes, 4 or 8: the bytes as one number, mixed one to one."""
    n = max(len(data) - shingle + 1, 0)
    windows = np.ndarray((n,), f"<u{shingle}", data, 0, (1,)) if n else np.zeros(0, np.uint64)
    return mix(windows.astype(np.uint64) * np.uint64(_BASE))


def _shingled(lines: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes and the number of the line that each belongs to; lines are of `shingle` bytes at least."""
    h = shingle_hashes(b"\0".join(lines), shingle)
    lengths = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    own = np.repeat(np.arange(len(lines)), lengths + 1)[: len(h)]
    inside = np.arange(len(h)) - starts[own] <= lengths[own] - shingle
    return h[inside], own[inside]


def _set_sizes(lines: list[bytes], shingle: int) -> np.ndarray:
    """How many distinct shingles each line has; lines are of `shingle` bytes at least."""
    h, own = _shingled(lines, shingle)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))[: len(h)]
    return np.bincount(own[fresh], minlength=len(lines))


def _named(keys: np.ndarray, salt: int) -> np.ndarray:
    """Each band has keys of its own."""
    return mix(keys + np.arange(1 + salt, keys.shape[1] + 1 + salt, dtype=np.uint64) * np.uint64(_BASE))


def long_bands(lines: list[bytes]) -> np.ndarray:
    """A row of BANDS keys for each line."""
    h, own = _shingled(lines, SHINGLE)
    minima = np.full(len(lines) * BINS, _NONE, np.uint64)
    np.minimum.at(minima, own * BINS + (h >> np.uint64(65 - BINS.bit_length())).astype(np.int64), h)
    minima = minima.reshape(-1, BINS)
    full, filled = minima != _NONE, minima.copy()
    row, column = np.nonzero(~full)
    for chosen in _BORROW:
        if not len(row):
            break
        source = chosen[column]
        has = full[row, source]
        filled[row[has], column[has]] = minima[row[has], source[has]]
        row, column = row[~has], column[~has]
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(0, BINS, BANDS):
        keys = keys * np.uint64(_BASE) + filled[:, r : r + BANDS]
    return _named(keys, 0)


def short_bands(lines: list[bytes]) -> np.ndarray:
    """A row of SHORT_BANDS keys for each line."""
    h, own = _shingled(lines, SHORT_SHINGLE)
    x = (h >> np.uint64(32)).astype(np.uint32)
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    keys = np.zeros((len(lines), SHORT_BANDS), np.uint64)
    for i in range(SHORT_BANDS * SHORT_ROWS):
        band = i // SHORT_ROWS
        keys[:, band] = keys[:, band] * np.uint64(_BASE) + np.minimum.reduceat(x * _A[i] + _B[i], starts)
    return _named(keys, BANDS)


def _in_steps(bands, lines: list[bytes], columns: int, step: int = 256) -> np.ndarray:
    """Few lines at a time, whose minima stay in the processor's cache."""
    return np.concatenate([np.zeros((0, columns), np.uint64), *(bands(lines[i : i + step]) for i in range(0, len(lines), step))])


def _signed(parts: int, min_chars: int):
    """Occurrences of all lines (kind 2) and band entries of the distinct ones, packed by linking.dealt()."""

    def run(it):
        release("line dedup")
        task = TaskContext.get().partitionId()
        seen, flushes = set(), 0
        found, keys, nodes, held = [], [], [], 0

        def flush():
            nonlocal found, keys, nodes, held, flushes
            flushes += 1
            if found:
                wide, place = (np.concatenate(x, axis=-1) for x in zip(*found))
                # Occurrences only travel along, so any part will do.
                where = int(mix(np.array([task * 1_000_003 + flushes], np.uint64))[0] % np.uint64(parts))
                yield rows_of([(where, 2, wide.tobytes() + place.tobytes())])
            if keys:
                yield dealt(np.concatenate(keys), np.concatenate(nodes), parts)
            found, keys, nodes, held = [], [], [], 0

        for big in it:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                docs, places, lines = [], [], []
                for i, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch)):
                    if i is not None:
                        for n, line in lines_of(text, min_chars):
                            docs.append(i)
                            places.append(n)
                            lines.append(line)
                if not lines:
                    continue
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)
                found.append((np.stack([both[:, 0], both[:, 1], np.array(docs, np.int64)]), np.array(places, np.int32)))
                names, fresh = both[:, 0].tolist(), []
                for i, x in enumerate(names):
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if len(seen) > MEMO_WORDS:
                    seen.clear()
                for bands, columns, low, high, turn in ((long_bands, BANDS, LONG_CHARS, None, 0), (short_bands, SHORT_BANDS, SHORT_SHINGLE, SHORT_CHARS, _TURN)):
                    own = [i for i in fresh if low <= len(lines[i]) and (high is None or len(lines[i]) <= high)]
                    if own:
                        keys.append(_in_steps(bands, [lines[i] for i in own], columns).ravel())
                        nodes.append(np.repeat(both[own, 0] ^ np.int64(turn), columns))
                        held += len(keys[-1])
                if held > FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _probes(nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each node in a filter of 2**k bits, as filter_of() sets them."""
    return nodes >> np.uint64(64 - k), (nodes << np.uint64(30)) >> np.uint64(64 - k)


def filter_of(nodes: DataFrame) -> np.ndarray:
    """A bit for each of two places of every node, set by Spark in slices of 4 KB: 2 to 4 bytes a node reach the driver, 128 MB at most."""
    k = min(30, max(15, (FILTER_BITS * nodes.count()).bit_length()))
    places = F.array(F.shiftrightunsigned("node", 64 - k) + 1, F.shiftrightunsigned(F.shiftleft("node", 30), 64 - k) + 1)
    at = nodes.select(F.explode(places).alias("at")).select(F.bitmap_bucket_number("at").alias("slice"), F.bitmap_bit_position("at").alias("bit"))
    out = np.zeros((1 << k >> 15, 4096), np.uint8)
    for i, bits in at.repartition("slice").groupBy("slice").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        out[i - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def passing(bits: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether nodes (unsigned) may be among those of the filter: all of these pass, and few others."""
    out = np.ones(len(nodes), bool)
    for at in _probes(nodes, len(bits).bit_length() + 2):
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _candidates(held, min_chars: int):
    """The lines that pass the filter, each once a task; a payload starts with the length of its shingles. A line is looked for under both its names."""

    def run(it):
        release("line dedup")
        bits, seen = held.value, set()
        for big in it:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                lines = [line for i, text in zip(column_of(batch, "doc_id").to_pylist(), texts_of(batch)) if i is not None for _, line in lines_of(text, min_chars)]
                if not lines:
                    continue
                names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x)[:8] for x in lines]), np.uint64)
                sizes = np.array([len(x) for x in lines], np.int64)
                nodes, shorts, counts, payloads = [], [], [], []
                for shingle, fit, turn in ((SHINGLE, sizes >= LONG_CHARS, 0), (SHORT_SHINGLE, (sizes >= SHORT_SHINGLE) & (sizes <= SHORT_CHARS), _TURN)):
                    own = np.flatnonzero(fit)
                    turned = names[own] ^ np.uint64(turn)
                    hit = passing(bits, turned)
                    fresh = []
                    for i, node in zip(own[hit].tolist(), turned[hit].view(np.int64).tolist()):
                        if node not in seen:
                            seen.add(node)
                            nodes.append(node)
                            fresh.append(lines[i])
                    shorts += [shingle == SHORT_SHINGLE] * len(fresh)
                    counts += _set_sizes(fresh, shingle).tolist()
                    payloads += [bytes([shingle]) + line for line in fresh]
                if len(seen) > MEMO_WORDS:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(shorts, pa.bool_()), pa.array(counts, pa.int64()), pa.array(payloads, pa.binary())], names=["node", "short", "n", "payload"])

    return run


def _shingles(payload: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(payload[1:], payload[0]))


def _turned(column: str) -> "F.Column":
    return F.col(column).bitwiseXOR(F.lit(_TURN))


def line_components(docs: DataFrame, entries: DataFrame, min_chars: int) -> DataFrame:
    """(h1, component) for the distinct lines that have links to others."""
    pairs, members = counted(entries, "lines")
    nodes = durable(members.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct(), "line-nodes")
    # The text of every candidate line, found once by its hash, so that no whole text is dealt; its shingles are hashed where it is compared. A node is h1 or, for short shingles, h1 turned.
    held = docs.sparkSession.sparkContext.broadcast(filter_of(nodes))
    found = durable(docs.mapInArrow(_candidates(held, min_chars), "node long, short boolean, n long, payload binary").dropDuplicates(["node"]), "candidate-lines")
    comps = link(pairs, members, found.select("node", "n", "payload"), PERCENT, _shingles, "lines")
    # A line's two nodes are one.
    twins = comps.join(found.where("short").select("node"), "node", "left_semi").select("node", _turned("node"))
    return connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(twins)).withColumnRenamed("node", "h1")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, places): for documents with repeated lines, the numbers of the lines that go."""
    docs = docs.select("doc_id", "text")
    sent = docs.mapInArrow(_signed(fine_parts(docs.sparkSession), min_chars), "part int, kind int, blob binary")
    both = durable(met(sent), "lines")
    lines = both.where("kind = 2").select(F.col("a").alias("h1"), F.col("b").alias("h2"), F.col("c").alias("doc_id"), F.col("d").alias("place"))
    comps = line_components(docs, both.where("kind = 0").select(F.col("a").alias("key"), F.col("b").alias("node")), min_chars)
    # A line without links is its own group, under both halves of its hash.
    named = lines.join(broadcast_if_few(durable(comps, "line-groups")), "h1", "left")
    named = named.select("doc_id", "place", F.coalesce("component", "h1").alias("g1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0)).alias("g2"))
    groups = named.groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = durable(groups.select("g1", "g2", F.col("first.doc_id").alias("first_doc"), F.col("first.place").alias("first_place")), "repeated-lines")
    gone = named.join(broadcast_if_few(groups), ["g1", "g2"]).where("doc_id <> first_doc or place <> first_place")
    return gone.groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def _without(it):
    release("line dedup")
    for batch in it:
        out, n_lines, n_gone = [], [], []
        for text, places in zip(texts_of(batch), column_of(batch, "places").to_pylist()):
            parts = text.split(b"\n")
            gone = set(places or ())
            out.append(b"\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
            n_lines.append(len(parts) if text else 0)
            n_gone.append(len(gone))
        at = batch.schema.get_field_index("text")
        columns = batch.columns[:-1]
        columns[at] = pa.array(out, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], names=[*batch.schema.names[:-1], "n_lines", "n_removed"])


def remove_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the texts that are left, and n_lines and n_removed behind the other columns (null texts become empty)."""
    places = repeated_lines(docs, min_chars)
    own = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c in ("places", "n_lines", "n_removed")})
    joined = own.join(places, "doc_id", "left").select(*own.columns, "places")
    schema = own.schema.add("n_lines", "long").add("n_removed", "long")
    return joined.mapInArrow(_without, schema)
