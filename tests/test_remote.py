"""A server's log directory, read over a fake connection."""

import re

import pytest

from logloom.schema import LogReadOptions
from logloom.sources.files import Remote, kinds, read_log
from logloom.sources.stores import RemoteStore, SqlServer, as_option, store

from .test_scan import PREFIX, csv_record, texts


class Server:
    """Files of a folder of this machine, as a server would give them out; text if asked for."""

    def __init__(self, folder, as_text=False):
        self.folder, self.as_text = str(folder), as_text

    def __call__(self):
        return self

    def list(self):
        import os

        return [(n, os.path.getsize(f"{self.folder}/{n}")) for n in sorted(os.listdir(self.folder))]

    def read(self, path, offset, length):
        with open(f"{self.folder}/{path.rsplit('/', 1)[1]}", "rb") as f:
            f.seek(offset)
            got = f.read(length)
        return got.decode() if self.as_text else got

    def close(self):
        pass


def rows(df):
    return sorted((r.file.rsplit("/", 1)[1], r.offset, r.raw, r._malformed, r.flags) for r in df.collect())


@pytest.mark.parametrize("chunk", [61, 1000, 10 << 20])
def test_any_chunk_gives_the_rows_of_local_files(spark, tmp_path, chunk):
    inner = "text\n" + csv_record(1, "inner").replace('"', '""') + "\n"
    (tmp_path / "a.csv").write_text("\n".join([*texts("csv", 12), csv_record(3, inner), "", csv_record(4, "é" * 90), "half a line"]))
    (tmp_path / "b.json").write_text("\n".join(texts("json", 20)) + "\n")
    (tmp_path / "c.log").write_text("\n".join(texts("stderr", 20)) + "\n")
    (tmp_path / "empty.log").write_text("")
    remote = Remote(Server(tmp_path), chunk, connections=3)
    want = rows(read_log(spark, str(tmp_path), malformed=True, glob="*"))
    assert len(want) > 50 and rows(read_log(spark, "/srv/log", malformed=True, glob="*", remote=remote)) == want
    assert {r[0] for r in rows(read_log(spark, "/srv/log", remote=remote, malformed=True))} == {"c.log"}
    assert rows(read_log(spark, "/srv/log/", LogReadOptions("csv"), malformed=True, remote=remote)) == [r for r in want if r[0] == "a.csv"]
    assert rows(read_log(spark, "/srv/log/b.json", malformed=True, remote=remote)) == [r for r in want if r[0] == "b.json"]
    assert {r.file: r.prefix for r in kinds(spark, "/srv/log", "[^ab]*", remote).collect()} == {"/srv/log/c.log": PREFIX}


def test_a_directory_must_be_named_and_may_be_empty(spark, tmp_path):
    remote = Remote(Server(tmp_path))
    assert read_log(spark, "/srv/log", LogReadOptions("json"), remote=remote).count() == 0
    with pytest.raises(Exception, match="needs its path"):
        read_log(spark, "", LogReadOptions("json"), remote=remote).count()


def test_chunks_are_no_larger_than_asked_and_text_is_bytes(tmp_path):
    (tmp_path / "a").write_text("é" * 1000)
    asked = []

    class Counted(Server):
        def read(self, path, offset, length):
            asked.append((offset, length))
            return super().read(path, offset, length)

    s = RemoteStore(Counted(tmp_path, as_text=True), 100)
    with s.open("/x/a") as f:
        assert f.read(150).decode() == "é" * 75 and f.seek(200) == 200 and f.read() == "é".encode() * 900
    assert max(n for _, n in asked) <= 100
    assert isinstance(store(as_option(Server(tmp_path))), RemoteStore)


class Database:
    """A DB-API connection that knows the two functions."""

    def __init__(self, files):
        self.files, self.said, self.closed = files, [], False

    def cursor(self):
        return self

    def execute(self, sql, values=()):
        self.said.append(sql)
        if "pg_ls_logdir" in sql:
            self.rows = [(n, len(x), 1_700_000_000.5) for n, x in self.files.items()]
        else:
            path, offset, length = values
            got = self.files[re.sub(".*/", "", path)][offset : offset + length]
            self.rows = [(got.decode() if "pg_read_file" in sql else memoryview(got),)]

    def fetchall(self):
        return self.rows

    def close(self):
        self.closed = True


@pytest.mark.parametrize("as_text", [False, True])
def test_sql_of_a_session(as_text):
    db = Database({"b.log": b"two\n", "a.log": b"one\n"})
    s = RemoteStore(SqlServer(lambda: db, as_text), 1 << 20)
    assert s.list("/d", None) == [("/d/a.log", 4), ("/d/b.log", 4)] and s.watch("/d/", "b*")[0].changed == 1_700_000_000_500_000_000
    with s.open("/d/b.log") as f:
        assert f.read() == b"two\n"
    s.close()
    assert any("pg_read_file(%s, %s, %s)" in x for x in db.said) == as_text
