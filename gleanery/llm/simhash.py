"""SimHash near-dedup: pivot distance tables over 64-bit fingerprints.

Equal fingerprints become one node first. Two nodes that differ in few bits agree
in some block of bits and, within the rest, in some smaller block; these blocks are
the keys by which nodes are dealt out, so that no task sees all. Inside a key's
group, each node's Hamming distances to the pivots form its row of the table. Rows
are sorted by the first distance, pairs whose distances differ anywhere by more
than the limit are discarded (triangle inequality), and survivors are verified.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_bytes, mix64, new_names, pieces, shared_folder, stored
from gleanery.llm.components import components

#: Reference fingerprints.
PIVOTS = mix64(np.arange(16), 6)
SEED = 42
LANES = np.uint64(0x0101010101010101)
#: Rows of a key that are compared in one task; larger groups are compared in pairs of blocks of so many.
GROUP_ROWS = 16_384


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 of each run of k words of the lower-cased text (fewer words: of all; none: none)."""
    words = text.lower().split()
    if not words:
        return []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip([0, *[e + 1 for e in ends]], ends[k - 1 :], strict=False)]


def _majorities(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text's hashes (sizes of them, at least one), the bits set in over half.

    Eight bits of a hash at a time are spread over the bytes of a number and added
    up, in runs of at most 255 so that bytes hold.
    """
    first = np.cumsum(sizes) - sizes
    runs = -(-sizes // 255)
    run_first = np.cumsum(runs) - runs
    starts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(run_first, runs))
    out = np.zeros(len(sizes), np.uint64)
    for shift in range(8):
        added = np.add.reduceat((flat >> np.uint64(shift)) & LANES, starts)
        counts = np.add.reduceat(added.view(np.uint8).reshape(-1, 8).astype(np.int64), run_first, axis=0)
        for lane in range(8):
            out |= (2 * counts[:, lane] > sizes).astype(np.uint64) << np.uint64(8 * lane + shift)
    return out


def _flat_hashes(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = [shingle_hashes(t, k) for t in texts]
    sizes = np.array([len(h) for h in hashes], np.int64)
    return np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum())), sizes


def fingerprints(texts: list[bytes], k: int = 3) -> np.ndarray:
    """A bit is 1 if it is set in over half of the text's shingle hashes; no shingles: 0."""
    flat, sizes = _flat_hashes(texts, k)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = _majorities(flat, sizes[some])
    return out


def fingerprint_documents(docs: DataFrame, k: int = 3, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """docs without text, with the fingerprint of each whole text as a bigint; null text: empty, 0."""
    rows = docs.select(*[c for c in docs.columns if c not in (column, text)], docs[text].alias(text))
    names = rows.columns[:-1]
    schema = rows.drop(text).select("*", F.lit(0).cast("bigint").alias(column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 4 << 20):
            found = fingerprints(as_bytes(batch.column(text)), k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*names, column])

    return rows.mapInArrow(run, schema)


def _block_keys(fp: Column, limit: int) -> Column:
    """Keys of which two fingerprints within limit bits share at least one.

    limit + 1 blocks: one agrees. In the rest, cut into as many, one agrees again.
    """
    n = limit + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    keys = []
    for b in range(n):
        size = cuts[b + 1] - cuts[b]
        turned = F.shiftleft(fp, 64 - cuts[b + 1]).bitwiseOR(F.shiftrightunsigned(fp, cuts[b + 1])) if cuts[b + 1] < 64 else fp
        block = F.shiftrightunsigned(turned, 64 - size)
        rest = 64 - size
        inner = [round(rest * i / n) for i in range(n + 1)]
        for s in range(n):
            sub = F.shiftrightunsigned(turned, inner[s]).bitwiseAND(F.lit((1 << (inner[s + 1] - inner[s])) - 1))
            keys.append(F.xxhash64(F.lit(b * n + s), block, sub) if size + inner[s + 1] - inner[s] > 40 else F.shiftleft(F.shiftleft(block, 20).bitwiseOR(sub), 6).bitwiseOR(F.lit(b * n + s)))
    return F.array(*keys)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _links(key: np.ndarray, fp: np.ndarray, limit: int, wide: np.ndarray | None = None, wide_limit: int = 0, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Pairs of rows that link within equal neighbouring keys, as many as tie each group together.

    The survivors of the table are verified by their own distance, that of the wide
    fingerprints if there are any, and alike (which of the pairs of rows link) if it
    is given. Rows already tied aren't looked at again, and a group that is tied as
    a whole is left.
    """
    n = len(fp)
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    table = np.stack([_popcount(fp ^ p) for p in PIVOTS], axis=1)
    order = np.lexsort((table[:, 0], group))
    fp, table, group = fp[order], table[order], group[order]
    label, rows, found = np.arange(n), np.arange(n), []
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    step = 0
    while True:
        step += 1
        rows = rows[rows + step < n]
        # sorted by group and first distance: who is out of reach now stays so
        rows = rows[(group[rows + step] == group[rows]) & (table[rows + step, 0] - table[rows, 0] <= limit)]
        if not len(rows):
            break
        a = rows[label[rows] != label[rows + step]]
        a = a[(np.abs(table[a] - table[a + step]) <= limit).all(axis=1)]
        a = a[_popcount(fp[a] ^ fp[a + step]) <= limit]
        if wide is not None and len(a):
            a = a[np.bitwise_count(wide[order[a]] ^ wide[order[a + step]]).sum(axis=1, dtype=np.int64) <= wide_limit]
        if alike is not None and len(a):
            a = a[alike(order[a], order[a + step])]
        if len(a):
            found.append(np.stack([order[a], order[a + step]], axis=1))
            label = _tie(label, a, a + step)
            whole = np.minimum.reduceat(label, starts) == np.maximum.reduceat(label, starts)
            rows = rows[~whole[group[rows]]]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _tie(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels once rows a and b are tied."""
    root, x, y = np.arange(len(label)), label[a], label[b]
    while True:
        x, y = root[x], root[y]
        go = x != y
        if not go.any():
            return root[label]
        x, y = x[go], y[go]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str = "key") -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by key, cut so that no key's rows are split; the last key is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(key)[0].as_py() != keys[0]):
            held.append(batch.slice(0, cut))
            yield pa.concat_batches(held)
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _bounded(dealt: DataFrame, node: str, most: int | None = None) -> DataFrame:
    """dealt (key, node and more) with the rows of a key of over `most` rows dealt out again, each two of them still meeting.

    Such a group is cut into blocks by a hash of the node, and each pair of blocks
    becomes a key; so a task holds 2 * most rows, more or less, whatever the group.
    The keys that are cut are few (one per `most` rows at most) and lie in a table,
    which Spark broadcasts if it is small.
    """
    most = most or GROUP_ROWS
    counted = dealt.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > most)
    hot = stored(counted.select(F.col("key").alias("hot"), F.ceil(F.col("many") / most).cast("int").alias("blocks")), "hot-groups")
    own = F.pmod(F.xxhash64(F.lit(3), node), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    joined = dealt.join(hot, F.col("key") == F.col("hot"), "left")
    names = [c for c in dealt.columns if c != "key"]
    return joined.select(*names, F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"))


def near_links(nodes: DataFrame, limit: int = 3, column: str = "fingerprint") -> DataFrame:
    """u, v: links of at most limit bits that tie together what such links tie together.

    nodes holds distinct fingerprints.
    """
    spark = nodes.sparkSession
    dealt = _bounded(nodes.select(F.col(column).alias("fp"), F.explode(_block_keys(F.col(column), limit)).alias("key")), "fp")
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches):
            fp = batch.column("fp").to_numpy()
            pairs = fp[_links(batch.column("key").to_numpy(), fp.view(np.uint64), limit)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def simhash_components(docs: DataFrame, k: int = 3, limit: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links reach) per document.

    Null or empty text: fingerprint 0, linked like any other. Texts of fewer than k
    words: one shingle. Null doc_id: kept, and never the smallest unless alone.
    Repeated rows stay, in one component. Only doc_id and text are read. Empty
    table: no rows.
    """
    found = stored(fingerprint_documents(docs.select("doc_id", "text"), k), "fingerprints")
    nodes = stored(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "nodes")
    links = components(near_links(nodes.select("fingerprint"), limit))
    named = nodes.join(links, F.col("fingerprint") == F.col("u"), "left").select("fingerprint", "least", F.coalesce("v", "fingerprint").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    of = named.join(smallest, F.col("root") == F.col("r")).select(F.col("fingerprint").alias("fp"), "component_id")
    return found.join(of, F.col("fingerprint") == F.col("fp")).select("doc_id", "fingerprint", "component_id")


# shingle similarity

#: 64-bit words of a wide fingerprint; bands of two smallest shingle hashes each.
WORDS, BANDS, IN_BAND = 16, 16, 2
#: Bytes of shingle sets, and open files, that a task holds.
HELD_BYTES, HELD_FILES = 64 << 20, 64


def wide_limits(similarity: float) -> tuple[int, int]:
    """Bits in which fingerprints of 64, and of 64 * WORDS bits, of similar texts differ at most.

    Two sets of equal size with Jaccard similarity j have cosine 2j / (1 + j), and a
    bit differs with probability p = angle / pi. Neither decides: the short one may
    go 5.7 standard deviations beyond the mean and the wide one 9.1, as p is up to a
    quarter more in sets of few shingles.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    reach = lambda bits, by: int(bits * p + by * np.sqrt(bits * p * (1 - p)))
    return reach(64, 5.7), reach(64 * WORDS, 9.1)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The distinct shingle hashes of each text in order, how many each has, and a hash of 128 bits of each set."""
    sets = [np.unique(np.array(shingle_hashes(t, k), np.uint64)) for t in texts]
    names = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(s) for s in sets], np.int64), names


def sketches(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wide fingerprints (texts x WORDS) and band keys (texts x BANDS) of sets of hashes; no shingles: zeros."""
    wide, keys = np.zeros((len(sizes), WORDS), np.uint64), np.zeros((len(sizes), BANDS), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        for w in range(WORDS):
            wide[some, w] = _majorities(mix64(flat, w) if w else flat, sizes[some])
        for b in range(BANDS):
            for r in range(IN_BAND):
                least = np.minimum.reduceat(mix64(flat, 1000 + b * IN_BAND + r), first)
                keys[some, b] = mix64(keys[some, b] ^ least, 2000 + b)
    return wide, keys


class Sets:
    """Shingle sets in files of the shared folder, by file number, place and size; some are held."""

    def __init__(self, folder: str) -> None:
        self.system, self.base = pfs.FileSystem.from_uri(folder)
        self.files, self.held, self.bytes = {}, {}, 0

    def get(self, file: int, at: int, many: int) -> np.ndarray:
        found = self.held.get((file, at))
        if found is None:
            if file not in self.files:
                if len(self.files) >= HELD_FILES:
                    self.files.pop(next(iter(self.files))).close()
                self.files[file] = self.system.open_input_file(sets_path(self.base, file))
            found = np.frombuffer(self.files[file].read_at(8 * many, 8 * at), "<u8")
            self.held[file, at] = found
            self.bytes += found.nbytes
            while self.bytes > HELD_BYTES and len(self.held) > 2:
                self.bytes -= self.held.pop(next(iter(self.held))).nbytes
        return found

    def alike(self, file: np.ndarray, at: np.ndarray, many: np.ndarray, similarity: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do the sets of rows a and b have a Jaccard similarity of so much or more? One answer per pair."""
        out = np.minimum(many[a], many[b]) / np.maximum(many[a], many[b]) >= similarity
        for i in np.flatnonzero(out).tolist():
            x, y = (self.get(int(file[r]), int(at[r]), int(many[r])) for r in (a[i], b[i]))
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            out[i] = both / (len(x) + len(y) - both) >= similarity
        return out


def sets_path(base: str, file: int) -> str:
    return f"{base}/sets-{file:016x}.bin"


def keep_one_of_each(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id.

    Texts link if their sets of k-word shingles have a Jaccard similarity of
    `similarity` or more. No blocks of equal bits are selective at such distances;
    bands of smallest shingle hashes deal texts out (a pair at 0.8 shares none once in
    12 million). Within a band's group the pivot table of the 64-bit fingerprints and
    the wide fingerprints discard, with limits far beyond what such pairs differ by,
    and the sets themselves decide. Tasks write the sets to files in the shared
    folder, and read those of surviving pairs.

    A shingle that a text repeats counts once. Texts with equal sets are one node
    from the start. Null and empty texts: equal texts without shingles. Very long
    texts: whole. Null doc_id: last. Of rows of one doc_id, a hash of 128 bits over all
    columns (but maps) decides, and of equal rows one stays. Columns stay as they are,
    whatever their names. Empty table: no rows.

    A task holds GROUP_ROWS rows of a band's group, or two blocks of so many of a larger
    one (some 200 bytes a row), and compares those that nothing ties yet.
    """
    spark = docs.sparkSession
    limit, wide_limit = wide_limits(similarity)
    hashed = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind]
    own = [F.xxhash64(F.lit(seed), *hashed) for seed in (0, 1)]
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(own[0].alias("a"), own[1].alias("b")).alias("uid"), F.col("text").alias("text"))

    folder = shared_folder(spark, "shingle-sets")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that runs again writes another file, and its rows name that one
        file, at, stream = uuid.uuid4().int >> 65, 0, None
        for batch in pieces(batches, "text", 2 << 20):
            flat, sizes, names = shingle_sets(as_bytes(batch.column("text")), k)
            if stream is None:
                system, base = pfs.FileSystem.from_uri(folder)
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(sets_path(base, file))
            stream.write(flat.astype("<u8").tobytes())
            places = at + np.cumsum(sizes) - sizes
            at += len(flat)
            wide, keys = sketches(flat, sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("uid"), pa.array(names, pa.binary()), pa.array(np.full(len(sizes), file)), pa.array(places), pa.array(sizes), pa.array([w.tobytes() for w in wide], pa.binary()), lists], ["id", "uid", "node", "file", "at", "many", "wide", "keys"])
        if stream is not None:
            stream.close()

    found = rows.mapInArrow(sketch, "id bigint, uid struct<a: bigint, b: bigint>, node binary, file bigint, at bigint, many bigint, wide binary, keys array<bigint>")
    # an id that is null sorts last
    rank = F.struct(F.col("id").isNull().alias("no"), "id", "uid", "file", "at")
    nodes = stored(found.groupBy("node", "many", "wide", "keys").agg(F.min(rank).alias("least")), "nodes")
    # without shingles: one node, which links to none
    dealt = _bounded(nodes.where("many > 0").select("node", "wide", "least.file", "least.at", "many", F.explode("keys").alias("key")), "node").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder)
        for batch in _whole_groups(batches):
            wide = np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.uint64).reshape(-1, WORDS)
            node = batch.column("node")
            alike = partial(sets.alike, *[batch.column(c).to_numpy() for c in ("file", "at", "many")], similarity)
            pairs = _links(batch.column("key").to_numpy(), np.ascontiguousarray(wide[:, 0]), limit, wide, wide_limit, alike)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(pairs[:, 0])), node.take(pa.array(pairs[:, 1]))], ["u", "v"])

    ties = components(dealt.mapInArrow(link, "u binary, v binary").distinct())
    # the links are stored, so the sets are used up
    system, base = pfs.FileSystem.from_uri(folder)
    if system.get_file_info(base).type == pfs.FileType.Directory:
        system.delete_dir(base)
    named = nodes.select("node", "least").join(ties, F.col("node") == F.col("u"), "left").select("least", F.coalesce("v", "node").alias("root"))
    keepers = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.uid.a").alias("k1"), F.col("least.uid.b").alias("k2"))
    n1, n2, k1, k2 = new_names(docs, "u1", "u2", "k1", "k2")
    marked = docs.select("*", own[0].alias(n1), own[1].alias(n2))
    kept = marked.join(keepers.toDF(k1, k2), (F.col(n1) == F.col(k1)) & (F.col(n2) == F.col(k2)), "left_semi")
    return kept.dropDuplicates([n1, n2]).drop(n1, n2)
