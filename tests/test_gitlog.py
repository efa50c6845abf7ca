"""The log source and the command line on a temporary repository."""

import io
import json
import os
import random
import subprocess

import pytest

from tandem import cli, render
from tandem.config import Options
from tandem.sources import gitlog


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    clock = [1_700_000_000]

    def run(*args):
        clock[0] += 86400
        env = os.environ | {"GIT_COMMITTER_DATE": f"{clock[0]} +0000", "GIT_AUTHOR_DATE": f"{clock[0]} +0000", "HOME": str(root)}
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, env=env)

    def commit(message, **files):
        for name, text in files.items():
            path = root / name.replace("__", "/").replace("_dot_", ".")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
        run("add", "-A")
        run("commit", "-qm", message)

    run("init", "-q")
    body = "\n".join(f"line {i}" for i in range(30))
    commit("first\x01", src__old_dot_ts=body, src__comp_dot_ts="1", docs__x_dot_md="a")
    commit("second", src__old_dot_ts=body + "!", src__comp_dot_ts="2")
    run("mv", "src/old.ts", "src/new.ts")
    commit("third", src__comp_dot_ts="3")
    commit("fourth", src__new_dot_ts=body + "?", src__comp_dot_ts="4")
    commit("fifth", docs__x_dot_md="b")
    (root / "src/new.ts").write_text("changed")
    (root / "extra.txt").write_text("new")
    return str(root)


def test_source_reads_baskets_in_order(spark, repo):
    rows = gitlog.history(spark, repo, renames="true").orderBy("ord").collect()
    assert [r.subject for r in rows] == ["fifth", "fourth", "third", "second", "first\x01"]
    assert rows[0].files == ["docs/x.md"] and rows[0].date.endswith("+00:00")
    assert [tuple(x) for x in rows[2].renames] == [("src/old.ts", "src/new.ts")]
    assert sorted(rows[2].files) == ["src/comp.ts", "src/new.ts"]
    assert gitlog.history(spark, repo, max_count="2").count() == 2
    assert gitlog.history(spark, repo, path="docs/x.md").count() == 2


def test_changed_set_universe_and_errors(spark, repo):
    got = sorted(map(tuple, gitlog.changed_set(spark, repo).collect()))
    assert got == [("extra.txt", "extra.txt"), ("src/new.ts", "src/new.ts")]
    assert {r.path for r in gitlog.universe(spark, repo).collect()} == {"docs/x.md", "src/comp.ts", "src/new.ts"}
    assert {r.path for r in gitlog.universe(spark, repo, "HEAD~3..HEAD~3").collect()} == {"docs/x.md", "src/comp.ts", "src/old.ts"}
    assert gitlog.is_tracked(repo, "src/new.ts") and not gitlog.is_tracked(repo, "src/*.ts")
    for bad in ("", "-x", "a b"):
        with pytest.raises(gitlog.LogError):
            gitlog.check_range(bad)
    with pytest.raises(gitlog.LogError):
        gitlog.decoded_ids(["xyz"])
    assert gitlog.object_format(repo) == "sha1" and gitlog.runtime_backend(repo, "pack-fast") == ("pack-fast", [])
    assert gitlog.since_time(repo, "1700000000") == 1_700_000_000 and 0 < gitlog.since_time(repo, "now") - gitlog.since_time(repo, "2 weeks ago") - 14 * 86400 + 3700 < 7400
    with pytest.raises(gitlog.LogError):
        list(gitlog.parse_log(b"\0h\x1f1\x1fd\x1fs\0\nX\0p\0"))
    with pytest.raises(gitlog.LogError):
        gitlog.name_of(b"\xff")


def call(*argv):
    out = io.StringIO()
    return cli.run(list(argv), out), out.getvalue()


def test_command_line(spark, repo, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    code, text = call("query", "src/new.ts", "--repo", repo, "--format", "json")
    found = json.loads(text)
    assert code == 0 and found["related"][0]["path"] == "src/comp.ts" and found["related"][0]["cochanges"] == 4
    assert all(r["path"] != "src/old.ts" for r in found["related"])
    code, text = call("audit", "--repo", repo, "--format", "json", "--fail-on-confidence", "medium")
    found = json.loads(text)
    assert code == 3 and [c["path"] for c in found["candidates"]] == ["src/comp.ts"] and found["enforcement"]["finding_count"] == 1
    assert found["seeds"] == ["extra.txt", "src/new.ts"]
    code, text = call("audit", "--repo", repo, "--min-confidence", "high")
    assert code == 0 and "no candidates met" in text and "Omitted" in text and "completeness=latency-bounded" in text
    text = call("explain", "src/comp.ts", "docs/x.md", "--repo", repo)[1]
    assert "cochanged=1" in text and "files=3" in text and "first\\x01" in text
    assert "no direct co-change" in call("explain", "docs/x.md", "src/new.ts", "--repo", repo, "--max-commits", "1")[1]
    assert "src/comp.ts" in call("diff", "--repo", repo)[1]
    code, text = call("eval", "--repo", repo, "--test-commits", "1", "--train-commits", "4", "--modes", "direct")
    assert code == 0 and "hit_rate_at_k" in text
    with pytest.raises(cli.UsageError):
        call("query", "no-such", "--repo", repo)


def test_command_line_keeps_bounds_and_shows_evidence(spark, repo, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)

    def together(*more):
        found = json.loads(call("query", "new.ts", "--repo", repo, "--format", "json", *more)[1])
        return {r["path"]: (r["cochanges"], [e["subject"] for e in r["evidence"]]) for r in found["related"]}

    assert together("--evidence", "2")["src/comp.ts"] == (4, ["fourth", "third"])
    assert together("--max-commits", "1") == {"src/comp.ts": (1, [])}
    assert together("--since", str(1_700_000_000 + 8 * 86400 - 10))["src/comp.ts"][0] == 2  # each call of git is a day later
    for backend, n in (("git", 4), ("git-remove-empty", 4), ("pack-scan", 4), ("git-batch", 2), ("git-batch-parallel", 2), ("git-diff-tree", 2), ("git-diff-tree-parallel", 2), ("git-rev-list", 2), ("gix", 2), ("hybrid", 2)):
        assert together("--history-backend", backend)["src/comp.ts"][0] == n, backend
    assert together("--history-backend", "pack-scan", "--scan-commits", "2")["src/comp.ts"][0] == 1
    assert together("--accuracy", "exact")["src/comp.ts"][0] == 4
    for bad in (("--accuracy", "exact", "--history-backend", "git"), ("--history-backend", "none"), ("--jobs", "0"), ("--accuracy", "no")):
        with pytest.raises(cli.UsageError):
            call("query", "src/new.ts", "--repo", repo, *bad)
    found = json.loads(call("audit", "--repo", repo, "--format", "json", "--evidence", "1")[1])
    assert [e["subject"] for e in found["candidates"][0]["evidence"]] == ["fourth"]
    assert json.loads(call("audit", "--repo", repo, "--format", "json", "--exclude", "src/*")[1])["candidates"] == []
    found = json.loads(call("diff", "--repo", repo, "--format", "json", "--evidence", "1")[1])
    assert [e["subject"] for e in found["related"][0]["evidence"]] == ["fourth"]


def test_paths_as_they_are_typed(spark, repo, monkeypatch):
    folder = os.path.join(repo, "src")
    for base, typed in ((repo, "src/new.ts"), (folder, "new.ts"), (folder, "../src/./new.ts"), (repo, os.path.join(folder, "new.ts")), (repo, "new.ts")):
        assert gitlog.resolved(spark, repo, base, typed) == "src/new.ts"
    for bad in ("", "none.ts", "/elsewhere/none.ts"):
        with pytest.raises(cli.UsageError):
            gitlog.resolved(spark, repo, repo, bad)


def test_each_seed_has_its_own_former_names(spark, tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    run("init", "-q")
    for name in ("oldA", "oldB"):
        (tmp_path / name).write_text(f"{name}\n" * 30)
    (tmp_path / "z").write_text("z")
    run("add", "-A")
    run("commit", "-qm", "one")
    run("mv", "oldA", "A")
    run("mv", "oldB", "B")
    run("commit", "-qam", "two")
    rows = gitlog.seed_histories(spark, str(tmp_path), ["A", "B"], Options(backend="git")).collect()
    assert {(r.seed, r.subject): sorted(r.files) for r in rows} == {
        ("A", "one"): ["A", "oldB", "z"], ("B", "one"): ["B", "oldA", "z"], ("A", "two"): ["A", "B"], ("B", "two"): ["A", "B"],
    }
    assert sorted(map(tuple, gitlog.exact_renames(spark, str(tmp_path)).collect())) == [(0, "oldA", "A"), (0, "oldB", "B")]


def test_source_matches_git_on_a_generated_history(spark, tmp_path):
    r = random.Random(4)

    def run(*args):
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True).stdout.decode()

    run("init", "-q")
    run("checkout", "-qb", "main")
    there = []
    for step in range(60):
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if there and kind < 0.15:
                run("rm", "-qf", there.pop(r.randrange(len(there))))
            elif there and kind < 0.3:
                old, new = there.pop(r.randrange(len(there))), f"moved {step} ü {r.randrange(99)}.txt"
                run("mv", old, new)
                there.append(new)
            else:
                name = r.choice([*there, f"d{r.randrange(4)}/f{r.randrange(30)}"])
                (tmp_path / name).parent.mkdir(exist_ok=True)
                (tmp_path / name).write_text("".join(f"{r.random()}\n" for _ in range(20)))
                run("add", name)
                there += [name] if name not in there else []
        run("commit", "-q", "--allow-empty", "-m", f"step {step}")
        if step % 20 == 10:
            run("checkout", "-qb", f"side{step}")
        if step % 20 == 15:
            run("checkout", "-q", "main")
            run("merge", "-q", "--no-edit", f"side{step - 5}")
    want = {}
    for commit in run("log", "--format=%H").split():
        files = run("diff-tree", "--root", "-r", "--no-commit-id", "-z", "--name-only", "--no-renames", "--diff-filter=ACMRT", commit)
        want[commit] = sorted(f for f in files.strip("\n").split("\0") if f.strip("\n"))
    want = {k: v for k, v in want.items() if v}
    for options in ({}, {"chunk": "7"}, {"chunk": "0"}, {"expand": "diff-tree", "chunk": "9"}):
        rows = gitlog.history(spark, str(tmp_path), **options).orderBy("ord").collect()
        assert {x.hash: sorted(x.files) for x in rows} == want and len({x.ord for x in rows}) == len(rows)
        assert [x.hash for x in rows] == [h for h in want if h in {x.hash for x in rows}]
    assert [x.hash for x in gitlog.history(spark, str(tmp_path), max_count="10").orderBy("ord").collect()] == list(want)[:10]


def test_text_rendering():
    assert render.escaped("a\nbé") == "a\\nbé"
    assert render.query_text("t", "direct", [{"path": "p", "score": 0.5, "cochanges": 2, "reason": "direct_cochange"}]) == "related t direct\n1 p co=2"
    assert render.as_json({"a": 1, "b": None}) == '{"a":1}'
