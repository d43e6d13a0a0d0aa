"""Objects, listings and line diffs of version control, from files made here."""

from __future__ import annotations

import difflib
import hashlib
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lodequery.operators import trace
from lodequery.sources import history


def loose(root, kind, content):
    data = f"{kind} {len(content)}\0".encode() + content
    own = hashlib.sha1(data).hexdigest()
    at = root / ".git/objects" / own[:2]
    at.mkdir(parents=True, exist_ok=True)
    (at / own[2:]).write_bytes(zlib.compress(data))
    return own


def size_of(kind, n):
    out, n, byte = b"", n >> 4, kind << 4 | n & 15
    while n:
        out += bytes([byte | 128])
        byte, n = n & 127, n >> 7
    return out + bytes([byte])


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def packed(root, rows):
    """A pack of (kind number, id, content, base): base is None, ("ofs", place in rows, delta) or ("ref", id, delta)."""
    body, at = b"PACK" + struct.pack(">II", 2, len(rows)), []
    for kind, own, content, base in rows:
        at.append(len(body))
        if base is None:
            body += size_of(kind, len(content)) + zlib.compress(content)
        elif base[0] == "ofs":
            back = at[-1] - at[base[1]]
            code, back = [back & 127], back >> 7
            while back:
                back -= 1
                code, back = [back & 127 | 128, *code], back >> 7
            body += size_of(6, len(base[2])) + bytes(code) + zlib.compress(base[2])
        else:
            body += size_of(7, len(base[2])) + bytes.fromhex(base[1]) + zlib.compress(base[2])
    order = sorted(range(len(rows)), key=lambda i: rows[i][1])
    counts = [sum(int(rows[i][1][:2], 16) <= b for i in order) for b in range(256)]
    idx = b"\377tOc" + struct.pack(">I", 2) + struct.pack(">256I", *counts) + b"".join(bytes.fromhex(rows[i][1]) for i in order) + b"\0" * 4 * len(rows) + struct.pack(f">{len(rows)}I", *(at[i] for i in order))
    (root / ".git/objects/pack").mkdir(parents=True, exist_ok=True)
    (root / ".git/objects/pack/pack-x.pack").write_bytes(body + b"\0" * 20)
    (root / ".git/objects/pack/pack-x.idx").write_bytes(idx + b"\0" * 40)


def blob_id(content):
    return hashlib.sha1(f"blob {len(content)}\0".encode() + content).hexdigest()


def test_loose_and_packed_objects(spark, tmp_path):
    base = b"".join(b"line %d\n" % i for i in range(2000))
    second = base[:1000] + b"inserted" + base[5000:]
    delta = varint(len(base)) + varint(len(second)) + bytes([0b10110000, 1000 & 255, 1000 >> 8]) + bytes([8]) + b"inserted"
    rest = len(base) - 5000
    delta += bytes([0b10110011, 5000 & 255, 5000 >> 8, rest & 255, rest >> 8])
    third = second[:4] + b"!"
    small = varint(len(second)) + varint(5) + bytes([0b10010000, 4]) + bytes([1]) + b"!"
    packed(tmp_path, [(3, blob_id(base), base, None), (3, blob_id(second), None, ("ofs", 0, delta)), (3, blob_id(third), None, ("ref", blob_id(second), small))])
    loose(tmp_path, "blob", b"")
    loose(tmp_path, "blob", third)  # in both places
    for n in ("1", "20000"):
        spark.dataSource.register(history.ObjectSource)
        rows = spark.read.format("version_objects").option("objects", n).load(str(tmp_path)).dropDuplicates(["id"]).collect()
        assert {r["id"]: bytes(r["content"]) for r in rows} == {blob_id(x): x for x in (base, second, third, b"")}
    assert history.objects(spark, str(tmp_path / "nothing")).count() == 0


@pytest.fixture
def repository(spark, tmp_path):
    """Three commits on main and a branch from the second: returns the root and the commits' ids."""
    root = str(tmp_path / "r")
    os.makedirs(f"{root}/.git")

    def commit(files, branch, time, *parents):
        rows = history.put(spark.createDataFrame([(p, bytearray(t)) for p, t in files.items()], "path string, content binary"), root, "blob")
        return history.committed(rows.select("path", F.col("id").alias("blob")), root, branch, f"at {time}", time, parents)

    one = {"a.md": b"see [[b]]\n", "log/1.md": b"x\n", "src/m.py": b"def f():\n    pass\n", "src/deep/er/z.bin": b"a\0b", "a-b": b"", "a/c": b"c"}
    two = one | {"log/1.md": b"x\ny\n", "src/m.py": b"def f():\n    return 1\n"}
    three = {k: v for k, v in two.items() if k != "a.md"} | {"new/a.md": one["a.md"], "src/deep/er/z.bin": b"a\0c", "src/n.py": b"class K:\n    pass"}
    side = two | {"s.md": b"[[x]]"}
    a = commit(one, "main", 10)
    b = commit(two, "main", 20, a)
    c = commit(three, "main", 30, b)
    d = commit(side, "side", 25, b)
    with open(f"{root}/.git/HEAD", "w") as f:
        f.write("ref: refs/heads/main\n")
    return root, (a, b, c, d), (one, two, three)


def test_listings_walks_and_changes(spark, repository):
    root, (a, b, c, d), (one, _, three) = repository
    found = history.objects(spark, root)
    of = spark.createDataFrame([("one", a), ("three", c)], "ref string, id string")
    rows = {(r["ref"], r["path"]): r["blob"] for r in history.listed(found, of).collect()}
    assert rows == {(n, p): blob_id(t) for n, files in (("one", one), ("three", three)) for p, t in files.items()}
    assert history.ref(root, "HEAD") == history.ref(root, "main") == c and history.ref(root, "side") == d and history.ref(root, a) == a
    with pytest.raises(ValueError):
        history.ref(root, "unknown")
    assert {r["id"] for r in history.ancestors(found, spark.createDataFrame([("d", d)], "ref string, id string")).collect()} == {a, b, d}
    assert history.merge_base(found, c, d) == b
    assert history.last_touching(found, c, "log") == (b, 20) and history.last_touching(found, c, "src/n.py") == (c, 30) and history.last_touching(found, c, "nowhere") is None
    assert {r["path"] for r in history.committed_since(spark, root, a).collect()} == {"log/1.md", "src/m.py", "a.md", "new/a.md", "src/deep/er/z.bin", "src/n.py"}
    assert {(r["rel_path"], r["text"]) for r in history.texts_at(found, of.where("ref = 'one'")).collect()} == {("a.md", "see [[b]]\n"), ("log/1.md", "x\n")}


def test_a_diff_is_read_as_a_changeset(spark, repository):
    root, (a, _, _, _), _ = repository
    lines = trace.diff_lines(history.diff(spark, root, a, "HEAD"))
    files = trace.diff_files(lines)
    got = {(r["path"], r["old_path"], r["change_type"], r["is_binary"]) for r in files.collect()}
    assert got == {("log/1.md", None, "modified", False), ("new/a.md", "a.md", "renamed", False), ("", None, "modified", True), ("src/m.py", None, "modified", False), ("src/n.py", None, "added", False)}
    hunk = {r["path"]: r for r in trace.diff_hunks(lines, files).collect()}
    assert hunk["src/m.py"]["lines"] == [" def f():", "-    pass", "+    return 1"] and hunk["src/n.py"]["identifiers"] == ["K"]
    assert (hunk["log/1.md"]["old_start"], hunk["log/1.md"]["old_len"], hunk["log/1.md"]["new_len"]) == (1, 1, 2)


def test_index_and_working_tree(spark, repository):
    root, _, (_, _, three) = repository
    entries = b""
    for path, text in sorted(three.items()):
        entry = b"\0" * 40 + bytes.fromhex(blob_id(text)) + struct.pack(">H", len(path)) + path.encode()
        entries += entry + b"\0" * (8 - len(entry) % 8)
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True) if not path.startswith("a/") else os.makedirs(f"{root}/a", exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(text)
    with open(f"{root}/.git/index", "wb") as f:
        f.write(b"DIRC" + struct.pack(">II", 2, len(three)) + entries)
    assert {r["path"]: r["blob"] for r in history.staged(spark, root).collect()} == {p: blob_id(t) for p, t in three.items()}
    assert history.worktree(spark, root).count() == 0 and history.diff(spark, root, "HEAD", None).count() == 0
    with open(f"{root}/src/n.py", "w") as f:
        f.write("changed")
    os.remove(f"{root}/a-b")
    with open(f"{root}/fresh.txt", "w") as f:
        f.write("")
    assert {tuple(r) for r in history.worktree(spark, root).collect()} == {("src/n.py", "modified"), ("a-b", "deleted"), ("fresh.txt", "untracked")}


def applied(old, hunks):
    """The new text that hunks make of the old one."""
    a, out, at = old.split("\n"), [], 0
    i = 0
    while i < len(hunks):
        begin, n = (hunks[i].split()[1][1:].split(",") + ["1"])[:2]
        begin = int(begin) - 1 if int(n) else int(begin)
        out += a[at:begin]
        at, i = begin, i + 1
        while i < len(hunks) and not hunks[i].startswith("@@"):
            sign, line = hunks[i][0], hunks[i][1:]
            if sign in " -":
                assert a[at] == line
                at += 1
            if sign in " +":
                out.append(line)
            i += 1
    return "\n".join(out + a[at:])


def test_hunks_make_the_new_text_with_few_edits():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randint(0, 40)
        a = [rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(n)]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(rng.randint(0, 5)):
            b.insert(rng.randint(0, len(b)), rng.choice("xyzab"))
        old, new = "".join(x + "\n" for x in a), "".join(x + "\n" for x in b)
        hunks = history.hunks(old, new)
        assert applied(old, hunks) == new
        edits = sum(x[0] in "+-" for x in hunks)
        assert edits <= sum(x[0] in "+-" and x[:3] not in ("+++", "---") for x in difflib.unified_diff(a, b, n=0, lineterm=""))
    # far more edits than are sought: lines that both have once part the texts
    a, b = [f"{i}-{rng.random()}" for i in range(300)], [f"{i}+{rng.random()}" for i in range(300)]
    b[100:104], b[250] = a[90:94], a[260]
    kept = history.kept_lines(a, b, most=50)
    assert [(90 + i, 100 + i) for i in range(4)] + [(260, 250)] == kept
    assert history.hunks("a", "a\n") == ["@@ -1 +1 @@", "-a", "\\ No newline at end of file", "+a"]
    assert history.hunks("", "") == [] and history.hunks("a\n", "") == ["@@ -1 +0,0 @@", "-a"]
