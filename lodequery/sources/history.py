"""Version control read from its own files: objects, commits, trees, what changed between two of them, and the changes as text.

Objects are read from loose files and from packs, whose deltas are resolved in the task that reads them, by a data source whose tasks take
folders of loose objects and ranges of a pack. Listings of a revision, ancestry and differences are joins over these rows; a walk takes
one join for each level of folders, or for each generation of commits. No program is called. The folder of the repository must be seen by driver and
executors under the same path.

Cases: a folder without objects gives no rows; a name that no ref has, and an id that no object has, is an error where one is asked for, else gives no
rows; objects that lie in several places are one; links inside a tree are files, modules of other repositories are left out; a changed file that holds a
zero byte in its first 8000 is binary; renames are seen where the contents are equal.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodequery.functions.text import let
from lodequery.operators.lexical import shared
from lodequery.sources import files

#: Kinds of objects in packs, modes of folders and of other repositories in trees, bytes looked at for zeros.
PACKED = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
FOLDER, MODULE, LOOK = "40000", "160000", 8000
OBJECT = pa.schema([("id", pa.string()), ("kind", pa.string()), ("content", pa.binary())])
OBJECT_SQL = "id string, kind string, content binary"


class Loose(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)


class Range(InputPartition):
    def __init__(self, pack: str, begin: int, end: int):
        super().__init__((pack, begin, end))


class Pack:
    """A pack file and its index; whole objects by place, with a bounded memory of the last bases."""

    def __init__(self, path: str, most: int = 64_000_000):
        with open(f"{path}.idx", "rb") as f:
            data = f.read()
        n = struct.unpack(">I", data[8 + 255 * 4 : 8 + 256 * 4])[0]
        names = 8 + 1024
        offsets = names + 24 * n
        self.ids = [data[names + 20 * i : names + 20 * i + 20] for i in range(n)]
        small = struct.unpack(f">{n}I", data[offsets : offsets + 4 * n])
        large = offsets + 4 * n
        self.at = [o if o < 2**31 else struct.unpack(">Q", data[large + 8 * (o - 2**31) : large + 8 * (o - 2**31) + 8])[0] for o in small]
        self.by_id = dict(zip(self.ids, self.at, strict=True))
        with open(f"{path}.pack", "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.known: OrderedDict[int, tuple[int, bytes]] = OrderedDict()
        self.held, self.most = 0, most

    def head(self, at: int) -> tuple[int, int]:
        """The kind of the object at a place, and where what follows its head begins."""
        byte = self.data[at]
        kind = byte >> 4 & 7
        at += 1
        while byte & 128:
            byte = self.data[at]
            at += 1
        return kind, at

    def inflated(self, at: int) -> bytes:
        unpack, out = zlib.decompressobj(), []
        while not unpack.eof:
            out.append(unpack.decompress(self.data[at : at + 65536]))
            at += 65536
        return b"".join(out)

    def whole(self, at: int) -> tuple[int, bytes]:
        """Kind and content: the chain of deltas down to a whole object or one that is still held, then up again."""
        chain, place = [], at
        while place not in self.known:
            kind, begin = self.head(place)
            if kind == 6:
                byte = self.data[begin]
                back, begin = byte & 127, begin + 1
                while byte & 128:
                    byte = self.data[begin]
                    back, begin = (back + 1 << 7) | byte & 127, begin + 1
                chain.append((place, self.inflated(begin)))
                place -= back
            elif kind == 7:
                chain.append((place, self.inflated(begin + 20)))
                place = self.by_id[self.data[begin : begin + 20]]
            else:
                self.keep(place, (kind, self.inflated(begin)))
                break
        found = self.known[place]
        for p, delta in reversed(chain):
            found = found[0], patched(found[1], delta)
            self.keep(p, found)
        return found

    def keep(self, at: int, found: tuple[int, bytes]) -> None:
        self.known[at] = found
        self.held += len(found[1])
        while self.held > self.most and len(self.known) > 1:
            self.held -= len(self.known.popitem(last=False)[1][1])


def patched(base: bytes, delta: bytes) -> bytes:
    """A base with a delta applied: two sizes, then copies from the base and inserts."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = delta[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value, at

    _, at = number(0)
    _, at = number(at)
    out = []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            field = [0] * 7
            for bit in range(7):
                if op >> bit & 1:
                    field[bit], at = delta[at], at + 1
            begin = int.from_bytes(bytes(field[:4]), "little")
            size = int.from_bytes(bytes(field[4:]), "little") or 65536
            out.append(base[begin : begin + size])
        else:
            out.append(delta[at : at + op])
            at += op
    return b"".join(out)


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = f"{folder_of(options['path'])}/objects"
        self.size = int(options.get("objects", "20000"))

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            return []
        out: list[InputPartition] = [Loose(f) for f in sorted(os.listdir(self.root)) if len(f) == 2]
        packs = f"{self.root}/pack"
        for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
            if name.endswith(".idx"):
                with open(f"{packs}/{name}", "rb") as f:
                    f.seek(8 + 255 * 4)
                    n = struct.unpack(">I", f.read(4))[0]
                out += [Range(f"{packs}/{name[:-4]}", i, min(n, i + self.size)) for i in range(0, n, self.size)]
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        if partition is None:  # no partitions
            return
        for row in self.loose(partition.value) if isinstance(partition, Loose) else self.packed(*partition.value):
            rows.append(row)
            held += len(row["content"]) + 100
            if held > 16_000_000:
                yield pa.RecordBatch.from_pylist(rows, OBJECT)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, OBJECT)

    def loose(self, folder: str) -> Iterator[dict]:
        for name in sorted(os.listdir(f"{self.root}/{folder}")):
            if len(name) == 38:
                with open(f"{self.root}/{folder}/{name}", "rb") as f:
                    head, _, content = zlib.decompress(f.read()).partition(b"\0")
                yield {"id": folder + name, "kind": head.split()[0].decode(), "content": content}

    def packed(self, path: str, begin: int, end: int) -> Iterator[dict]:
        pack = Pack(path)
        order = sorted(range(len(pack.ids)), key=lambda i: pack.at[i])[begin:end]  # bases mostly stand before what is made of them
        for i in order:
            kind, content = pack.whole(pack.at[i])
            yield {"id": pack.ids[i].hex(), "kind": PACKED[kind], "content": content}


class ObjectSource(DataSource):
    """id, kind and content of every object of a repository. Options: path; objects, how many of a pack a task reads."""

    @classmethod
    def name(cls) -> str:
        return "version_objects"

    def schema(self) -> str:
        return OBJECT_SQL

    def reader(self, schema) -> DataSourceReader:
        return ObjectReader(self.options)


def folder_of(root: str) -> str:
    """The folder that holds the objects: .git of a working tree, else the root itself."""
    at = root.removeprefix("file://").rstrip("/")
    return f"{at}/.git" if os.path.isdir(f"{at}/.git") else at


def objects(spark: SparkSession, root: str) -> DataFrame:
    """id, kind (commit, tree, blob, tag) and content of every object, each once."""
    spark.dataSource.register(ObjectSource)
    return spark.read.format("version_objects").load(root).dropDuplicates(["id"])


def ref(root: str, name: str) -> str:
    """The id that a name stands for: HEAD, a branch, a tag, a full ref or an id itself."""
    at = folder_of(root)
    known = {}
    if os.path.exists(f"{at}/packed-refs"):
        with open(f"{at}/packed-refs") as f:
            known = {line.split()[1]: line.split()[0] for line in f if line[:1] not in "#^\n"}
    for full in (name, f"refs/{name}", f"refs/heads/{name}", f"refs/tags/{name}", f"refs/remotes/{name}"):
        value = known.get(full)
        if os.path.isfile(f"{at}/{full}"):
            with open(f"{at}/{full}") as f:
                value = f.read().strip()
        if value:
            return ref(root, value[5:]) if value.startswith("ref: ") else value
    if len(name) == 40 and all(c in "0123456789abcdef" for c in name):
        return name
    raise ValueError(f"no ref {name}")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder, so that walks don't grow the plan."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared(spark))
    return df.checkpoint()


def commits(found: DataFrame) -> DataFrame:
    """id, tree, parents, time (seconds, of the committer) and message of the commits among objects."""
    text = F.decode("content", "UTF-8")
    head = F.substring_index(text, "\n\n", 1)
    rows = found.where("kind = 'commit'").select("id", text.alias("text"), head.alias("head"))
    return rows.select(
        "id", F.regexp_extract("head", r"(?m)^tree ([0-9a-f]{40})$", 1).alias("tree"), F.regexp_extract_all("head", F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"),
        F.regexp_extract("head", r"(?m)^committer .*> (-?[0-9]+) [+-][0-9]{4}$", 1).try_cast("long").alias("time"), F.expr("substring(text, length(head) + 3)").alias("message"),
    )


def tree_entries(found: DataFrame) -> DataFrame:
    """tree, mode, name and child of the entries of all trees among objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"tree": [], "mode": [], "name": [], "child": []}
            for own, data in zip(b.column("id").to_pylist(), b.column("content").to_pylist(), strict=True):
                at = 0
                while at < len(data):
                    end = data.index(b"\0", at)
                    mode, _, name = data[at:end].partition(b" ")
                    for key, value in (("tree", own), ("mode", mode.decode()), ("name", name.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()), ("child", data[end + 1 : end + 21].hex())):
                        out[key].append(value)
                    at = end + 21
            yield pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.string()) for k in out]))

    return found.where("kind = 'tree'").select("id", "content").mapInArrow(run, "tree string, mode string, name string, child string")


def listed(found: DataFrame, of: DataFrame) -> DataFrame:
    """ref, path, mode and blob of every file of the revisions `of` (ref, id of a commit)."""
    entries, trees = cut(tree_entries(found)), commits(found).select("id", "tree")
    open_ = cut(of.join(trees, "id").select("ref", F.lit("").alias("path"), "tree"))
    out = None
    while not open_.isEmpty():  # a level of folders each time
        inside = open_.join(entries, "tree").where(F.col("mode") != MODULE).select("ref", F.concat("path", "name").alias("path"), "mode", "child")
        inside = cut(inside)
        own = inside.where(F.col("mode") != FOLDER).select("ref", "path", "mode", F.col("child").alias("blob"))
        out = own if out is None else out.unionByName(own)
        open_ = inside.where(F.col("mode") == FOLDER).select("ref", F.concat("path", F.lit("/")).alias("path"), F.col("child").alias("tree"))
    return of.sparkSession.createDataFrame([], "ref string, path string, mode string, blob string") if out is None else out


def ancestors(found: DataFrame, of: DataFrame) -> DataFrame:
    """ref and id of the commits `of` (ref, id) and of all before them."""
    parents = cut(commits(found).select("id", F.explode("parents").alias("parent")))
    seen = last = cut(of.select("ref", "id").distinct())
    while not last.isEmpty():  # a generation each time
        last = cut(last.join(parents, "id").select("ref", F.col("parent").alias("id")).distinct().join(seen, ["ref", "id"], "left_anti"))
        seen = cut(seen.unionByName(last))
    return seen


def merge_base(found: DataFrame, a: str, b: str) -> str | None:
    """The latest commit that both have among their ancestors; None without one."""
    spark = found.sparkSession
    both = ancestors(found, spark.createDataFrame([("a", a), ("b", b)], "ref string, id string")).groupBy("id").count().where("count = 2")
    row = both.join(commits(found).select("id", "time"), "id").orderBy(F.desc("time"), "id").first()
    return row and row["id"]


def last_touching(found: DataFrame, head: str, path: str) -> tuple[str, int] | None:
    """The id and time of the last commit up to `head` that changed what lies at a path (a file or folder), None where none did: a commit that has there what one
    of its parents has didn't change it, and a first commit changed what it has."""
    spark = found.sparkSession
    own = ancestors(found, spark.createDataFrame([("h", head)], "ref string, id string")).select("id")
    every = cut(commits(found).join(own, "id", "left_semi"))
    entries, at = cut(tree_entries(found)), every.select("id", F.col("tree").alias("child"))
    for name in path.strip("/").split("/"):
        at = at.join(entries.where(F.col("name") == name).select(F.col("tree").alias("_t"), F.col("child").alias("_c")), F.col("child") == F.col("_t"), "left").select("id", F.col("_c").alias("child"))
    at = cut(at.select("id", F.coalesce("child", F.lit("-")).alias("has")))
    rows = every.select("id", "time", F.explode_outer("parents").alias("parent")).join(at, "id").join(at.select(F.col("id").alias("parent"), F.col("has").alias("had")), "parent", "left")
    changed = rows.groupBy("id", "time").agg(F.min(F.col("has") != F.coalesce("had", F.lit("-"))).alias("changed")).where("changed")
    row = changed.orderBy(F.desc("time"), "id").first()
    return row and (row["id"], row["time"])


def changes(old: DataFrame, new: DataFrame, renames: bool = True) -> DataFrame:
    """ref, path, old_path, status (added, deleted, modified, renamed), old_blob and new_blob of the files in which two listings (ref, path, blob) differ."""
    a, b = (df.select("ref", "path", F.col("blob").alias(n)) for df, n in ((old, "old_blob"), (new, "new_blob")))
    rows = a.join(b, ["ref", "path"], "full_outer").where(~F.col("old_blob").eqNullSafe(F.col("new_blob")))
    status = F.when(F.col("old_blob").isNull(), "added").when(F.col("new_blob").isNull(), "deleted").otherwise("modified")
    rows = rows.select("ref", "path", F.lit(None).cast("string").alias("old_path"), status.alias("status"), "old_blob", "new_blob")
    if not renames:
        return rows
    nth = lambda blob: F.row_number().over(Window.partitionBy("ref", blob).orderBy("path"))
    gone = rows.where("status = 'deleted'").select("ref", F.col("path").alias("_from"), F.col("old_blob").alias("_blob"), nth("old_blob").alias("_n"))
    come = rows.where("status = 'added'").withColumn("_n", nth("new_blob"))
    pairs = come.join(gone, (come["ref"] == gone["ref"]) & (come["new_blob"] == gone["_blob"]) & (come["_n"] == gone["_n"])).select(come["ref"], "path", "_from", F.col("_blob").alias("blob"))
    moved = pairs.select("ref", "path", F.col("_from").alias("old_path"), F.lit("renamed").alias("status"), F.col("blob").alias("old_blob"), F.col("blob").alias("new_blob"))
    ends = pairs.select("ref", F.explode(F.array(F.struct("path", F.lit("added").alias("status")), F.struct(F.col("_from").alias("path"), F.lit("deleted").alias("status")))).alias("x")).select("ref", "x.path", "x.status")
    return rows.join(ends, ["ref", "path", "status"], "left_anti").select(*rows.columns).unionByName(moved)


def staged(spark: SparkSession, root: str) -> DataFrame:
    """path and blob of the files of the index, as it is kept beside the objects; of those under conflict none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column("at").to_pylist():
                with open(at, "rb") as f:
                    data = f.read()
                version, n = struct.unpack(">II", data[4:12])
                if version not in (2, 3):
                    raise ValueError(f"index version {version}")
                out, place = {"path": [], "blob": []}, 12
                for _ in range(n):
                    flags = struct.unpack(">H", data[place + 60 : place + 62])[0]
                    begin = place + (64 if flags & 0x4000 else 62)
                    end = data.index(b"\0", begin)
                    if not flags >> 12 & 3:
                        out["path"].append(data[begin:end].decode("utf-8", "replace"))
                        out["blob"].append(data[place + 40 : place + 60].hex())
                    place += (end - place) // 8 * 8 + 8
                yield pa.RecordBatch.from_pydict(out, pa.schema([("path", pa.string()), ("blob", pa.string())]))

    at = f"{folder_of(root)}/index"
    rows = [(at,)] if os.path.exists(at) else []
    return spark.createDataFrame(rows, "at string").mapInArrow(run, "path string, blob string")


def worktree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (".git",)) -> DataFrame:
    """path, status (modified, deleted, untracked) of the files of a working tree that differ from the index."""
    now = files.all_files(spark, root, exclude).select("path", files.content_id(F.col("content")).alias("now"))
    rows = staged(spark, root).join(now, "path", "full_outer").where(~F.col("blob").eqNullSafe(F.col("now")))
    return rows.select("path", F.when(F.col("blob").isNull(), "untracked").when(F.col("now").isNull(), "deleted").otherwise("modified").alias("status"))


# ---- changes as text ---------------------------------------------------------------------------


def shortest(a: list, b: list, most: int) -> list[tuple[int, int]] | None:
    """Places (i, j) of the lines that a shortest edit from a to b keeps, by furthest reaching paths; None beyond `most` edits."""
    n, m, reach, steps = len(a), len(b), {1: 0}, []
    down = lambda reach, k, d: k == -d or k != d and reach[k - 1] < reach[k + 1]
    for d in range(min(n + m, most) + 1):
        steps.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if down(reach, k, d) else reach[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            reach[k] = x
        if reach.get(n - m, -1) >= n and (n - m - d) % 2 == 0:
            break
    else:
        return None
    kept, x, y = [], n, m
    for d in range(len(steps) - 1, -1, -1):
        k = x - y
        before = k + 1 if down(steps[d], k, d) else k - 1
        x0 = steps[d][before] if d else 0
        y0 = x0 - before if d else 0
        while x > x0 and y > y0:
            x, y = x - 1, y - 1
            kept.append((x, y))
        x, y = (x0, y0) if d else (0, 0)
    return kept[::-1]


def kept_lines(a: list, b: list, most: int = 1000) -> list[tuple[int, int]]:
    """Places (i, j) of lines kept from a to b, rising in both. Equal ends are kept; between them a shortest edit, or where that has more than
    `most` edits, the lines that both have once, in their longest common order, and so on between those; a stretch without any is replaced whole."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle: list[tuple[int, int]] = []
    if x and y:
        found = shortest(x, y, most)
        if found is None:
            found, i0, j0 = [], 0, 0
            for i, j in [*rising(x, y), (len(x), len(y))]:
                if i0 or j0 or (i, j) != (len(x), len(y)):
                    found += [(i0 + p, j0 + q) for p, q in kept_lines(x[i0:i], y[j0:j], most)]
                if i < len(x):
                    found.append((i, j))
                i0, j0 = i + 1, j + 1
        middle = [(head + i, head + j) for i, j in found]
    return [(i, i) for i in range(head)] + middle + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def rising(a: list, b: list) -> list[tuple[int, int]]:
    """Lines that a and b have once each, the most of them that stand in the same order in both."""
    from bisect import bisect_left
    from collections import Counter

    once_a, once_b = Counter(a), Counter(b)
    where = {line: j for j, line in enumerate(b)}
    pairs = [(i, where[line]) for i, line in enumerate(a) if once_a[line] == 1 and once_b.get(line) == 1]
    ends: list[int] = []
    last: list[int] = []
    link: list[int] = []
    for p, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        link.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [j], [p]
    out, p = [], last[-1] if last else -1
    while p >= 0:
        out.append(pairs[p])
        p = link[p]
    return out[::-1]


def hunks(old: str, new: str, context: int = 3) -> list[str]:
    """The lines of a unified diff's hunks, with `context` lines around each change."""
    a, b = old.split("\n"), new.split("\n")
    # a text that ends in a line end has no line after it; one that doesn't says so
    marks = [len(x) - 1 if x[-1] != "" else -1 for x in (a, b)]
    a, b = (x if x[-1] != "" else x[:-1] for x in (a, b))
    key = lambda x, mark: [(line, i == mark) for i, line in enumerate(x)]
    kept = [*kept_lines(key(a, marks[0]), key(b, marks[1])), (len(a), len(b))]
    changed, i0, j0 = [], 0, 0  # ranges of a and of b that take each other's place
    for i, j in kept:
        if i > i0 or j > j0:
            changed.append((i0, i, j0, j))
        i0, j0 = i + 1, j + 1
    groups: list[list[tuple]] = []
    for c in changed:
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = []
    for g in groups:
        begin = max(0, g[0][0] - context)
        end = min(len(a), g[-1][1] + context)
        shift = g[0][2] - g[0][0], g[-1][3] - g[-1][1]
        size = lambda at, n: f"{at + 1 if n else at}" + ("" if n == 1 else f",{n}")
        heading = next((a[i] for i in range(begin - 1, -1, -1) if a[i][:1].isalpha() or a[i][:1] in ("_", "$")), "")[:80].rstrip()
        out.append(f"@@ -{size(begin, end - begin)} +{size(begin + shift[0], end + shift[1] - begin - shift[0])} @@" + (f" {heading}" if heading else ""))

        def put(sign: str, x: list, at: int, mark: int) -> None:
            out.append(sign + x[at])
            if at == mark:
                out.append("\\ No newline at end of file")

        place = begin
        for i, i1, j, j1 in g:
            for p in range(place, i):
                put(" ", a, p, marks[0])
            for p in range(i, i1):
                put("-", a, p, marks[0])
            for p in range(j, j1):
                put("+", b, p, marks[1])
            place = i1
        for p in range(place, end):
            put(" ", a, p, marks[0])
    return out


def patch_of(path: str, old_path: str | None, status: str, old: bytes | None, new: bytes | None) -> str:
    """One file's part of a diff."""
    a, b = old_path or path, path
    out = [f"diff --git a/{a} b/{b}"]
    out += {"added": ["new file mode 100644"], "deleted": ["deleted file mode 100644"], "renamed": ["similarity index 100%", f"rename from {a}", f"rename to {b}"]}.get(status, [])
    if status != "renamed" and (old or b"") != (new or b""):
        names = ("/dev/null" if old is None else f"a/{a}"), ("/dev/null" if new is None else f"b/{b}")
        if any(b"\0" in (x or b"")[:LOOK] for x in (old, new)):
            out.append(f"Binary files {names[0]} and {names[1]} differ")
        else:
            out += [f"--- {names[0]}", f"+++ {names[1]}", *hunks((old or b"").decode("utf-8", "replace"), (new or b"").decode("utf-8", "replace"))]
    return "\n".join(out) + "\n"


def patches(found: DataFrame, changed: DataFrame) -> DataFrame:
    """ref, path and patch (its part of the diff as text) of changed files, as changes() gives them."""
    blobs = found.where("kind = 'blob'").select("id", "content")
    one = lambda rows, side: rows.join(blobs.select(F.col("id").alias(f"{side}_blob"), F.col("content").alias(side)), f"{side}_blob", "left")
    rows = one(one(changed, "old"), "new").select("ref", "path", "old_path", "status", "old", "new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [patch_of(*(r[c] for c in ("path", "old_path", "status", "old", "new"))) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("ref"), b.column("path"), pa.array(text, pa.string())], ["ref", "path", "patch"])

    return rows.mapInArrow(run, "ref string, path string, patch string")


def changesets(found: DataFrame, changed: DataFrame) -> DataFrame:
    """ref and text: the whole diff of each ref, its files by path, as operators/trace.py takes them."""
    rows = patches(found, changed).groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("path", "patch"))).alias("x"))
    return rows.select("ref", F.array_join(F.transform("x", lambda x: x["patch"]), "").alias("text"))


def diff(spark: SparkSession, root: str, base: str, head: str | None) -> DataFrame:
    """ref and text of what changed from one revision to another (None: to the index), as one changeset."""
    found = objects(spark, root)
    at = lambda name: listed(found, spark.createDataFrame([(head or "index", ref(root, name))], "ref string, id string"))
    new = at(head) if head else staged(spark, root).select(F.lit("index").alias("ref"), "path", "blob")
    return changesets(found, changes(at(base), new))


def committed_since(spark: SparkSession, root: str, base: str, head: str = "HEAD") -> DataFrame:
    """Paths that differ between two revisions; of a renamed file both."""
    found = objects(spark, root)
    at = lambda name: listed(found, spark.createDataFrame([("r", ref(root, name))], "ref string, id string"))
    return changes(at(base), at(head), renames=False).select("path")


def texts_at(found: DataFrame, of: DataFrame, suffix: str = ".md") -> DataFrame:
    """ref, rel_path and text of the files of revisions (ref, id) whose names end in `suffix`, as operators/wiki.py takes pages."""
    rows = listed(found, of).where(F.endswith("path", F.lit(suffix))).join(found.where("kind = 'blob'").select(F.col("id").alias("blob"), "content"), "blob")
    return rows.select("ref", F.col("path").alias("rel_path"), files.decoded("content").alias("text"))


# ---- writing -----------------------------------------------------------------------------------


def object_id(kind: str, content: Column) -> Column:
    head = F.concat(F.lit(f"{kind} ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.unhex(F.lit("00")))
    return F.sha1(F.concat(head, content))


def put(rows: DataFrame, root: str, kind: str) -> DataFrame:
    """Writes rows (content, and columns to keep) as loose objects and gives them with their id in place of the content; what is there stays."""
    at = f"{folder_of(root)}/objects"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for content in b.column("content").to_pylist():
                data = f"{kind} {len(content)}\0".encode() + content
                own = hashlib.sha1(data).hexdigest()
                path = f"{at}/{own[:2]}/{own[2:]}"
                if not os.path.exists(path):
                    os.makedirs(f"{at}/{own[:2]}", exist_ok=True)
                    with open(f"{path}.{os.getpid()}", "wb") as f:
                        f.write(zlib.compress(data, 1))
                    os.replace(f"{path}.{os.getpid()}", path)
                ids.append(own)
            keep = [c for c in b.schema.names if c != "content"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(ids, pa.string())], [*keep, "id"])

    keep = [f for f in rows.schema.fields if f.name != "content"]
    return cut(rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "id string"])))


def committed(listing: DataFrame, root: str, branch: str, message: str, time: int, parents: tuple[str, ...] = ()) -> str:
    """Writes the trees and the commit of a listing (path, blob), points a branch at it, and gives its id."""
    spark = listing.sparkSession
    rows = listing.select(F.split("path", "/").alias("parts"), F.lit("100644").alias("mode"), F.col("blob").alias("id"))
    rows = rows.select(F.expr("array_join(slice(parts, 1, size(parts) - 1), '/')").alias("folder"), F.element_at("parts", -1).alias("name"), "mode", "id")
    deep = rows.agg(F.max(F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))))).first()[0] or 0
    level = lambda: F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    for d in range(deep, -1, -1):  # the deepest folders first
        here = rows.where(level() == d)
        entry = F.concat(F.encode(F.concat("mode", F.lit(" "), "name"), "UTF-8"), F.unhex(F.lit("00")), F.unhex("id"))
        order = F.encode(F.concat("name", F.when(F.col("mode") == FOLDER, "/").otherwise("")), "UTF-8")
        gathered = here.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), entry.alias("e")))).alias("x"))
        trees = gathered.select("folder", let(F.transform("x", lambda x: F.hex(x["e"])), lambda h: F.unhex(F.array_join(h, ""))).alias("content"))
        made = put(trees, root, "tree")
        if d == 0:
            top = made.first()
            break
        parts = F.split("folder", "/")
        up = made.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"), F.element_at(parts, -1).alias("name"), F.lit(FOLDER).alias("mode"), "id")
        rows = rows.where(level() < d).unionByName(up)
    who = f"lodequery <> {time} +0000"
    body = "".join([f"tree {top['id']}\n", *(f"parent {p}\n" for p in parents), f"author {who}\n", f"committer {who}\n\n{message}\n"])
    own = put(spark.createDataFrame([(bytearray(body.encode()),)], "content binary"), root, "commit").first()["id"]
    at = f"{folder_of(root)}/refs/heads/{branch}"
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(at, "w") as f:
        f.write(f"{own}\n")
    return own
