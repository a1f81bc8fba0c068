"""Python Data Source: listing, decoding, errors, archives."""

import os
import zipfile

from rulesift.plans.scan import scan
from rulesift.sources.code_tree import read_code_tree


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)


def test_tree_listing_keeps_hidden_empty_and_underscore(spark, tmp_path):
    root = tmp_path / "repos"
    write(str(root / "alpha/__init__.py"), b"")
    write(str(root / "alpha/.hid.py"), b"x = 1\n")
    write(str(root / "alpha/_x/y.py"), b"x = 1\n")
    write(str(root / "alpha/node_modules/w.py"), b"x = 1\n")
    write(str(root / "alpha/venv/v.py"), b"x = 1\n")
    write(str(root / "alpha/notes.txt"), b"x")
    write(str(root / "beta/readme.md"), b"# nothing")
    files = read_code_tree(spark, str(root), repo_depth=1, branch="main")
    rows = sorted((r.repo, r.path, r.length) for r in files.collect())
    assert rows == [("alpha", ".hid.py", 6), ("alpha", "__init__.py", 0), ("alpha", "_x/y.py", 6),
                    ("beta", None, None)]
    res = scan(files)
    totals = {r.repo: (r.files_scanned, r.overall_status) for r in res.scan_totals.collect()}
    # y.py has a one-letter stem (policy 6); beta has no Python file and passes
    assert totals == {"alpha": (3, "fail"), "beta": (0, "pass")}


def test_bad_bytes_are_replaced(spark, tmp_path):
    root = tmp_path / "r"
    write(str(root / "loader_job.py"), b"\xff\xfeabc\xc3\n" + b'token = "abcd1234"\n')
    files = read_code_tree(spark, str(root), repo="org/r")
    res = scan(files).findings.collect()
    assert [(r.policy_id, r.line_number) for r in res] == [(2, 2)]
    from pyspark.sql import functions as F
    from rulesift.functions.text import decode_utf8
    text = files.select(decode_utf8(F.col("content")).alias("t")).first().t
    assert text.startswith("��abc�\n")


def test_unreadable_file_counts_but_has_no_findings(spark, tmp_path):
    root = tmp_path / "r"
    write(str(root / "ok_module.py"), b"x = 1\n")
    write(str(root / "etl.py"), b"x = 1\n")
    os.chmod(str(root / "etl.py"), 0)
    try:
        files = read_code_tree(spark, str(root), repo="org/r")
        rows = {r.path: r.read_error for r in files.collect()}
        res = scan(files)
        totals = res.scan_totals.first()
        if os.geteuid() != 0:      # root can read anything
            assert rows["etl.py"] is not None
            assert res.findings.count() == 0
        assert totals.files_scanned == 2
    finally:
        os.chmod(str(root / "etl.py"), 0o644)


def test_zip_archive(spark, tmp_path):
    z = tmp_path / "upload_project.zip"
    with zipfile.ZipFile(z, "w") as zf:
        zf.writestr("k/__init__.py", "")
        zf.writestr("k/y.py", 'p = "/mnt/raw/x"\n')
        zf.writestr("k/venv/z.py", "x\n")
        zf.writestr("k/readme.md", "x\n")
    files = read_code_tree(spark, archives=str(tmp_path / "*.zip"), branch="main")
    rows = sorted((r.repo, r.path) for r in files.collect())
    assert rows == [("upload_project", "k/__init__.py"), ("upload_project", "k/y.py")]
    res = scan(files).findings.collect()
    assert sorted((r.policy_id, r.file_path) for r in res) == [(2, "k/y.py"), (6, "k/y.py")]


def test_archive_names_and_unpacked_size(spark, tmp_path):
    z = tmp_path / "p.zip"
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr(".tox/kept_module.py", "x = 1\n")
        zf.writestr("node_modules/gone_module.py", "x = 1\n")
        zf.writestr("a/same_module.py", "first = 1\n")
        zf.writestr("a/same_module.py", "last = 1\n")
        zf.writestr("a/bomb_module.py", "#" * 200_000)
    files = read_code_tree(spark, archives=str(z), branch="main", max_archive_bytes=100_000)
    rows = {r.path: (bytes(r.content) if r.content is not None else None, r.read_error) for r in files.collect()}
    assert set(rows) == {".tox/kept_module.py", "a/same_module.py", "a/bomb_module.py"}
    assert rows["a/same_module.py"][0] == b"last = 1\n" and "beyond" in rows["a/bomb_module.py"][1]


def test_folders_are_walked_by_tasks(spark, tmp_path):
    for r in range(3):
        for d in range(20):
            write(str(tmp_path / f"repos/r{r}/d{d}/deep/module_{d}.py"), b"x = 1\n")
    files = read_code_tree(spark, str(tmp_path / "repos"), repo_depth=1, max_partition_folders=7)
    assert files.rdd.getNumPartitions() == 9  # 3 repositories of 20 folders and their own files
    assert files.where("path IS NOT NULL").count() == 60 and scan(files).file_counts.where("files_scanned = 20").count() == 3


def test_folder_that_cannot_be_listed(spark, tmp_path, monkeypatch):
    from rulesift.sources import code_tree

    write(str(tmp_path / "r/ok/module_one.py"), b"x = 1\n")
    reader = code_tree.CodeTreeReader({"path": str(tmp_path / "r"), "repo": "org/r"})
    (part,) = reader.partitions()
    part.folders.append(("org/r", str(tmp_path / "r"), "missing", 0))
    rows = list(reader.read(part))
    assert [(r[2], r[5] is None) for r in rows] == [(None, True), ("ok/module_one.py", True), (None, False)]


def test_archive_above_limit_refused(spark, tmp_path):
    z = tmp_path / "big.zip"
    with zipfile.ZipFile(z, "w") as zf:
        zf.writestr("a.py", "x = 1\n" * 100)
    files = read_code_tree(spark, archives=str(z), max_archive_bytes=10)
    rows = files.collect()
    assert len(rows) == 1 and rows[0].path is None and rows[0].read_error


def test_many_files_spread_over_partitions(spark, tmp_path):
    root = tmp_path / "big"
    for i in range(50):
        write(str(root / f"mod_{i:03d}.py"), b"x = 1\n")
    files = read_code_tree(spark, str(root), repo="org/big", split=5, max_partition_folders=1)
    assert files.rdd.getNumPartitions() == 5
    assert files.count() == 50


def test_filters_are_pushed_into_the_source(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    from rulesift.sources import code_tree, storage

    for org in ("o", "p"):
        for r in range(20):
            for d in ("src", "lib"):
                write(str(tmp_path / f"t/{org}/r{r}/{d}/deep/module_{d}.py"), b"x = 1\n")
    listed = []
    plain = storage.Mounted.list
    monkeypatch.setattr(storage.Mounted, "list", lambda self, path: listed.append(os.path.relpath(path, tmp_path / "t")) or plain(self, path))

    def rows(*filters):
        listed.clear()
        reader = code_tree.PushingReader({"path": str(tmp_path / "t"), "repo_depth": "2", "content": "false"})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them again
        return sorted((r[0], r[2]) for p in reader.partitions() for r in reader.read(p) if r[2])

    every = rows()
    assert len(every) == 80 and len(set(listed)) == 3 + 40 * 5
    assert rows(EqualTo(("repo",), "o/r3"), IsNotNull(("path",))) == [x for x in every if x[0] == "o/r3"]
    assert len(listed) == len(set(listed)) + 1 and all(x.startswith("o/r3") for x in listed)  # its own folder: by the driver, and by a task
    assert rows(In(("repo",), ("o/r3", "p/r4", "no/r", "../t/o", None)), StringStartsWith(("path",), "src/")) == [("o/r3", "src/deep/module_src.py"), ("p/r4", "src/deep/module_src.py")]
    assert not any("lib" in x for x in listed)
    assert rows(StringStartsWith(("repo",), "p/r1"), EqualTo(("path",), "lib/deep/module_lib.py")) == [(f"p/r{k}", "lib/deep/module_lib.py") for k in (1, *range(10, 20))]
    assert "o" not in listed and not any("src" in x for x in listed)

    whole = read_code_tree(spark, str(tmp_path / "t"), repo_depth=2)
    two = read_code_tree(spark, str(tmp_path / "t"), repos=["o/r3", "p/r4"], path_prefix="src/", repo_depth=2)
    assert sorted((r.repo, r.path) for r in two.where("path IS NOT NULL").collect()) == [("o/r3", "src/deep/module_src.py"), ("p/r4", "src/deep/module_src.py")]
    assert two.rdd.getNumPartitions() == 1 < whole.rdd.getNumPartitions()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = read_code_tree(spark, str(tmp_path / "t"), repo_depth=2, pushdown="true").where("repo = 'o/r3' AND path LIKE 'src/%'")
        assert [(r.repo, r.path) for r in one.collect()] == [("o/r3", "src/deep/module_src.py")] and one.rdd.getNumPartitions() == 1
        # plain loads are planned each for itself
        files = read_code_tree(spark, str(tmp_path / "t"), repo_depth=2).where("path IS NOT NULL")
        assert files.where("repo = 'o/r3'").union(files.where("repo = 'p/r4'")).count() == 4
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_uris_are_read_through_the_store(spark, tmp_path):
    for k, name in enumerate(("a/load one.py", "a/.hid.py", "b/_x/é.py", "venv/no.py", "a/notes.txt")):
        write(str(tmp_path / "t" / name), b"x = %d\n" % k)
    with zipfile.ZipFile(tmp_path / "up.zip", "w") as zf:
        zf.writestr("k/jobs.py", "x = 1\n")
    rows = lambda df: sorted((r.repo, str(r.path), bytes(r.content or b""), r.read_error) for r in df.collect())
    plain = read_code_tree(spark, str(tmp_path / "t"), repo="r")
    assert rows(read_code_tree(spark, f"file://{tmp_path}/t", repo="r")) == rows(plain) and plain.where("path IS NOT NULL").count() == 3
    assert rows(read_code_tree(spark, archives=f"file://{tmp_path}/*.zip")) == [("up", "k/jobs.py", b"x = 1\n", None)]
    missing = read_code_tree(spark, f"file://{tmp_path}/none", repo="r").collect()
    assert [(r.repo, r.path, bool(r.read_error)) for r in missing] == [("r", None, True)]


def test_archives_are_packed_and_dealt(spark, tmp_path):
    for k in range(3000):
        with zipfile.ZipFile(tmp_path / f"s{k}.zip", "w") as zf:
            zf.writestr(f"a/m_{k}.py", "x = 1\n")
    files = read_code_tree(spark, archives=str(tmp_path / "s*.zip"), branch="main")
    assert files.rdd.getNumPartitions() == -(-3000 // 256)
    assert files.select("repo").distinct().count() == 3000 == files.where("path IS NOT NULL").count()
    rng = __import__("random").Random(1)
    with zipfile.ZipFile(tmp_path / "large.zip", "w", zipfile.ZIP_DEFLATED) as zf:
        for k in range(400):
            zf.writestr(f"d{k % 7}/mod_{k}.py", "".join(f"v{rng.random()}\n" for _ in range(rng.randrange(400))))
        zf.writestr("d0/mod_0.py", "last = 1\n")
    large = dict(archives=str(tmp_path / "large.zip"), branch="main")
    whole, dealt = read_code_tree(spark, **large), read_code_tree(spark, **large, split_archive_bytes=100_000)
    assert whole.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() > 8
    rows = lambda df: sorted((r.repo, r.path, bytes(r.content)) for r in df.collect())
    assert rows(whole) == rows(dealt) and len(rows(dealt)) == 400 and ("large", "d0/mod_0.py", b"last = 1\n") in rows(dealt)
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as zf:
        zf.writestr("readme.md", "x" * 1000)
    (tmp_path / "torn.zip").write_bytes(b"PK" + b"x" * 1000)
    for name in ("none", "torn"):
        got = read_code_tree(spark, archives=str(tmp_path / f"{name}.zip"), split_archive_bytes=100).collect()
        assert [(r.repo, r.path, bool(r.read_error)) for r in got] == [(name, None, name == "torn")]


def test_read_errors_that_any_user_meets(spark, tmp_path):
    write(str(tmp_path / "r/ok_module.py"), b"x = 1\n")
    os.symlink(tmp_path / "gone.py", tmp_path / "r/etl.py")  # a link to nothing
    files = read_code_tree(spark, str(tmp_path / "r"), repo="org/r")
    assert {r.path: bool(r.read_error) for r in files.collect()} == {"ok_module.py": False, "etl.py": True}
    res = scan(files)
    assert res.findings.collect() == [] and res.scan_totals.first().files_scanned == 2
