"""A Python data source for version-control logs: format("commit_log").

Options: repo (folder of a git repository, default "."), or log (file with such a log); renames (true adds the renames column's
content), max_count, since, path (a literal name that baskets must touch), ids (the commits to expand, blank-separated), expand
(log or diff-tree), chunk (commits a partition, 0 for one partition). Commit ids are listed first, then expanded in parallel, each
partition by one subprocess whose output is parsed as it comes. Output that is not valid UTF-8, is malformed or
lacks an asked commit is an error, never a shortened history. ord numbers the commits walked; those that bring no item are left out.
"""

from __future__ import annotations

import os
import subprocess
import threading
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..config import Options, UsageError
from ..operators import renames
from ..schema import BASKETS, CHANGED_SET

#: Bounds of a listing that is held whole, and of what is kept of an error message.
MAX_OUTPUT, MAX_ERROR = 64 << 20, 1 << 20
CHUNK = 512
#: Bounds of a latency-bounded walk: commits, least commits, hits, and commits since the last hit.
WALK_CAP, WALK_LEAST, WALK_HITS, WALK_STALL = 17500, 1000, 256, 5000
#: One record: NUL, then hash, committer time, date and subject parted by 0x1f, NUL, then names, each ended by NUL.
FORMAT = "--format=%x00%H%x1f%ct%x1f%cI%x1f%s%x00"


class LogError(RuntimeError):
    """A log that can't be read whole."""


def git_stream(repo: str, *args: str, given: bytes = b"", ok: tuple[int, ...] = (0,)) -> Iterator[bytes]:
    """git's output in pieces; both other pipes are served by threads, so none can block the rest."""
    with subprocess.Popen(["git", "-C", repo, *args], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        said = bytearray()

        def feed():
            try:
                run.stdin.write(given)
                run.stdin.close()
            except BrokenPipeError:
                pass

        def drain():
            while piece := run.stderr.read1(1 << 16):
                said.extend(piece[: MAX_ERROR - len(said)])

        threads = [threading.Thread(target=f, daemon=True) for f in (feed, drain)]
        for t in threads:
            t.start()
        try:
            while piece := run.stdout.read1(1 << 16):
                yield piece
        except GeneratorExit:
            run.kill()
            raise
        for t in threads:
            t.join()
        run.wait()
    if run.returncode not in ok:
        raise LogError(said.decode(errors="replace").strip() or f"git ended with {run.returncode}")


def git(repo: str, *args: str, ok: tuple[int, ...] = (0,)) -> bytes:
    """git's output whole, bounded in size."""
    out = bytearray()
    for piece in git_stream(repo, *args, ok=ok):
        out += piece
        if len(out) > MAX_OUTPUT:
            raise LogError(f"git printed more than {MAX_OUTPUT} bytes")
    return bytes(out)


def tokens(pieces: Iterable[bytes], end: bytes = b"\0") -> Iterator[bytes]:
    """The pieces' content, parted at each end mark; what follows the last one only if there is something."""
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(end)
        yield from whole
    if rest:
        yield rest


def lines(pieces: Iterable[bytes]) -> Iterator[str]:
    return (t.decode() for t in tokens(pieces, b"\n") if t)


def name_of(raw: bytes) -> str:
    try:
        text = raw.decode()
    except UnicodeDecodeError as error:
        raise LogError(f"a path is not valid UTF-8: {raw!r}") from error
    return "/".join(p for p in text.split("/") if p not in ("", "."))


def iso_date(text: str) -> str:
    return text[:-1] + "+00:00" if text.endswith("Z") else text


@dataclass
class Basket:
    """One commit of a log."""

    hash: str
    unix_time: int
    date: str
    subject: str
    files: list[str] = field(default_factory=list)
    renames: list[tuple[str, str]] = field(default_factory=list)

    def add(self, name: str) -> None:
        if name not in self.files:
            self.files.append(name)


def parse_log(raw: bytes | Iterable[bytes], statuses: bool = True) -> Iterator[Basket]:
    """Baskets of a log of FORMAT with -z, and with --name-status (statuses; deletions are passed over) or --name-only."""
    found = tokens([raw] if isinstance(raw, bytes) else raw)
    token = next(found, None)
    while token is not None:
        if token in (b"", b"\n"):
            token = next(found, None)
            continue
        head = token.split(b"\x1f", 3)
        if len(head) < 4:
            raise LogError(f"a record has {len(head)} header fields")
        own = Basket(head[0].decode(), int(head[1]), iso_date(head[2].decode()), head[3].decode(errors="replace"))
        token = next(found, None)
        if token == b"":
            token = next(found, None)
        if token is not None and token.startswith(b"\n"):  # one line feed stands before the first name
            token = token[1:]
            while token:
                if statuses:
                    kind = token[:1]
                    names = [next(found, b"") for _ in range(2 if kind in (b"R", b"C") else 1)]
                    if kind not in (b"A", b"M", b"T", b"R", b"C", b"D") or not all(names):
                        raise LogError(f"unexpected status {token!r}")
                    if kind != b"D":
                        own.add(name_of(names[-1]))
                    if kind == b"R":
                        own.renames.append((name_of(names[0]), name_of(names[1])))
                else:
                    own.add(name_of(token))
                token = next(found, None)
        yield own


class CommitLog(DataSource):
    """spark.read.format("commit_log").option("repo", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "commit_log"

    def schema(self) -> StructType:
        return BASKETS

    def reader(self, schema: StructType) -> DataSourceReader:
        return CommitLogReader(dict(self.options))


class Commits(InputPartition):
    """Some commits of a walk, and the number of the first."""

    def __init__(self, first: int, ids: list[str]):
        super().__init__(first)
        self.first, self.ids = first, ids


class CommitLogReader(DataSourceReader):
    """Partitions of a walk from its newest commit; the driver lists ids, the tasks expand them."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def selected(self) -> Iterator[str]:
        """The walk's commit ids, newest first. With max_count only commits that bring an item are counted."""
        o = self.options
        since = [f"--since={o['since']}"] if o.get("since") else []
        path = ["--", f":(literal){o['path']}"] if o.get("path") else []
        if "ids" in o:
            return iter(decoded_ids(o["ids"].split()))
        if o.get("max_count", "0") != "0" or path:
            count = [f"--max-count={o['max_count']}"] if o.get("max_count", "0") != "0" else []
            picked = git_stream(o.get("repo", "."), "log", FORMAT, "-z", "--name-only", "--diff-filter=ACMRT", "--no-renames", *count, *since, *path)
            return (b.hash for b in parse_log(picked, statuses=False) if b.files)
        return lines(git_stream(o.get("repo", "."), "rev-list", *since, "HEAD"))

    def partitions(self) -> list[InputPartition]:
        if self.options.get("log"):
            return [Commits(0, [])]
        ids, size = list(self.selected()), int(self.options.get("chunk", CHUNK))  # 40 bytes a commit
        size = size or max(1, len(ids))
        return [Commits(at, ids[at : at + size]) for at in range(0, len(ids), size)]

    def read(self, partition: InputPartition):
        o = self.options
        if o.get("log"):
            with open(o["log"], "rb") as file:
                for i, b in enumerate(parse_log(iter(lambda: file.read(1 << 16), b""))):
                    yield i, b.hash, b.unix_time, b.date, b.subject, b.files, b.renames
            return
        finds = "--find-renames" if o.get("renames", "false") == "true" else "--no-renames"
        how = ["diff-tree", "--stdin", "--root", "-r"] if o.get("expand") == "diff-tree" else ["log", "--no-walk=unsorted", "--stdin"]
        place = {h: i for i, h in enumerate(partition.ids)}
        for b in parse_log(git_stream(o.get("repo", "."), *how, FORMAT, "-z", "--name-status", finds, given="".join(f"{h}\n" for h in partition.ids).encode())):
            if b.hash not in place:
                raise LogError(f"commit {b.hash} was not asked for")
            i = place.pop(b.hash)
            if b.files:
                yield partition.first + i, b.hash, b.unix_time, b.date, b.subject, b.files, b.renames
        if place and o.get("expand") != "diff-tree":  # which passes over merges
            raise LogError(f"no answer for commit {next(iter(place))}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommitLog)


def history(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """A repository's baskets, newest first by ord."""
    register(spark)
    return spark.read.format("commit_log").option("repo", repo).options(**options).load()


def decoded_ids(ids: Iterable[str]) -> list[str]:
    """Commit ids in order, each once; anything else is an error."""
    found = list(dict.fromkeys(ids))
    for text in found:
        if len(text) not in (40, 64) or text.strip("0123456789abcdef"):
            raise LogError(f"not a commit id: {text!r}")
    return found


def since_time(repo: str, text: str | None) -> int | None:
    """Epoch seconds of a time as git reads it: seconds, a date, or "2 weeks ago"."""
    if text is None:
        return None
    if str(text).strip().isdigit() and len(str(text).strip()) > 8:
        return int(text)
    said = git(repo, "rev-parse", f"--since={text}").decode().strip()
    return int(said.removeprefix("--max-age="))


def followed(repo: str, target: str, max_count: int = 0, since: int | None = None, *more: str) -> list[tuple[str, set[str]]]:
    """Commits that touch a path through its renames, newest first, each with the path's names there."""
    args = ["log", FORMAT, "-z", "--name-status", "--diff-filter=ACMRT", "--find-renames", "--follow", *more]
    args += [f"--max-count={max_count}"] if max_count else []
    args += [f"--since={since}"] if since is not None else []
    found = parse_log(git_stream(repo, *args, "--", target))
    return [(b.hash, {*b.files, *(old for old, _ in b.renames)}) for b in found]


def bounded(walk: Iterable[str], hits: set[str], cap: int = WALK_CAP, least: int = WALK_LEAST, enough: int = WALK_HITS, stall: int = WALK_STALL) -> set[str]:
    """The commits that a latency-bounded walk visits; as operators.history.bounded_scan, over ids."""
    visited, met, last = set(), 0, 0
    for i, commit in enumerate(walk):
        if i >= cap:
            break
        visited.add(commit)
        if commit in hits:
            met, last = met + 1, i
        if i + 1 >= least and (met >= enough or (met and i - last >= stall)):
            break
    return visited


def selected(repo: str, target: str, o: Options) -> list[tuple[str, set[str]]]:
    """Commits of a target by the options' backend, newest first, with the target's names there.

    git and git-remove-empty follow renames; the pack backends follow exact ones, within a walk of scan_commits or, for
    pack-fast, a latency-bounded one; all others know the present name only, git-rev-list by the walk's own simplification.
    """
    literal = f":(literal){target}"
    since = [f"--since={o.since}"] if o.since is not None else []
    if o.backend in ("git", "git-remove-empty"):
        return followed(repo, target, o.max_baskets, o.since, *(["--remove-empty"] if o.backend == "git-remove-empty" else []))
    if o.backend.startswith("pack"):
        found = followed(repo, target, 0, o.since, "--find-renames=100%")
        walk = lines(git_stream(repo, "rev-list", *since, "HEAD"))
        if o.backend == "pack-fast":
            seen = bounded(walk, {h for h, _ in found})
        else:
            seen = {h for i, h in enumerate(walk) if not o.scan_commits or i < o.scan_commits}
        found = [x for x in found if x[0] in seen]
        return found[: o.max_baskets] if o.max_baskets else found
    count = [f"--max-count={o.max_baskets}"] if o.max_baskets else []
    if o.backend == "git-rev-list":
        return [(h, {target}) for h in lines(git_stream(repo, "rev-list", *count, *since, "HEAD", "--", literal))]
    picked = git_stream(repo, "log", FORMAT, "-z", "--name-only", "--diff-filter=ACMRT", "--no-renames", *count, *since, "--", literal)
    return [(b.hash, {target}) for b in parse_log(picked, statuses=False) if b.files]


def seed_histories(spark: SparkSession, repo: str, seeds: list[str], o: Options) -> DataFrame:
    """Rows (seed, ord, hash, unix_time, date, subject, files): each seed's commits, its former names there under its present one.

    Seeds are selected in o.jobs threads, every commit is expanded once, and a name is a seed's former one in that seed's rows alone.
    """
    with ThreadPoolExecutor(o.jobs) as pool:
        picked = dict(zip(seeds, pool.map(lambda s: selected(repo, s, o), seeds)))
    names = [(s, i, h, n) for s, found in picked.items() for i, (h, own) in enumerate(found) for n in {*own, s}]
    schema = "seed string, __place long, hash string, alias string"
    alias = spark.createDataFrame(names, schema)
    ids = list(dict.fromkeys(h for found in picked.values() for h, _ in found))
    options = {"ids": " ".join(ids), "expand": "diff-tree" if "diff-tree" in o.backend else "log"}
    options |= {"chunk": "0"} if o.backend in ("git-batch", "git-diff-tree") else {}
    baskets = history(spark, repo, **options).drop("renames", "ord")
    rows = baskets.join(alias.select("seed", F.col("__place").alias("ord"), "hash").distinct(), "hash")
    named = renames.follow(rows, alias.where("alias <> seed").select("seed", F.col("__place").alias("ord"), "alias"))
    return named.where(F.array_contains("files", F.col("seed")))


# ------------------------------------------------------------------------------------------------------------ changed sets


def parse_changes(raw: bytes) -> list[tuple[str, str]]:
    """(path, history_path) of `git diff --name-status -z`: a rename is looked up under its old name."""
    pieces, out, at = raw.split(b"\0"), [], 0
    while at < len(pieces) and pieces[at]:
        kind, names = pieces[at][:1], 2 if pieces[at][:1] in (b"R", b"C") else 1
        if kind not in b"ADMTURC" or at + names >= len(pieces):
            raise LogError(f"unexpected status {pieces[at]!r}")
        new = name_of(pieces[at + names])
        out.append((new, name_of(pieces[at + 1]) if kind == b"R" else new))
        at += 1 + names
    return sorted(dict(sorted(out)).items())


def changes(repo: str, *args: str) -> list[tuple[str, str]]:
    return parse_changes(git(repo, "diff", "--name-status", "-z", "--find-renames", *args))


def check_range(text: str) -> str:
    if not text or text.startswith("-") or any(c.isspace() for c in text):
        raise LogError(f"not a revision range: {text!r}")
    return text


def changed_set(spark: SparkSession, repo: str, staged: bool = False, range_: str | None = None) -> DataFrame:
    """path, history_path: of a range (under its new names), of the index, or of the whole worktree."""
    if range_ is not None:
        rows = [(new, new) for new, _ in changes(repo, check_range(range_), "--")]
        return spark.createDataFrame(rows, CHANGED_SET)
    index = spark.createDataFrame(changes(repo, "--cached"), CHANGED_SET)
    if staged:
        return index
    from ..operators.changedset import worktree

    others = [(name_of(p), name_of(p)) for p in git(repo, "ls-files", "--others", "--exclude-standard", "-z").split(b"\0") if p]
    return worktree(index, spark.createDataFrame(changes(repo), CHANGED_SET), spark.createDataFrame(others, CHANGED_SET))


def diff_names(spark: SparkSession, repo: str, staged: bool) -> DataFrame:
    """Visible names of staged or else unstaged changes."""
    return spark.createDataFrame([(p, p) for p, _ in changes(repo, *(["--cached"] if staged else []))], CHANGED_SET)


def universe(spark: SparkSession, repo: str, range_: str | None = None) -> DataFrame:
    """Tracked paths: of the index, or of the tree at a range's right end (HEAD if that is blank)."""
    if range_ is None:
        raw = git(repo, "ls-files", "--cached", "-z")
    else:
        right = check_range(range_).split("...")[-1] if "..." in range_ else range_.split("..")[-1]
        raw = git(repo, "ls-tree", "-r", "--name-only", "-z", right or "HEAD")
    return spark.createDataFrame([(name_of(p),) for p in raw.split(b"\0") if p], "path string").distinct()


def is_tracked(repo: str, path: str) -> bool:
    return bool(git(repo, "ls-files", "--error-unmatch", "-z", "--", f":(literal){path}", ok=(0, 1)))


def root(repo: str) -> str:
    return git(repo, "rev-parse", "--show-toplevel").decode().rstrip("\n")


def object_format(repo: str) -> str:
    return git(repo, "rev-parse", "--show-object-format").decode().strip()


def runtime_backend(repo: str, backend: str) -> tuple[str, list[str]]:
    """The backend that can read the repository, and hints: pack readers need SHA-1 objects that are all here."""
    hints = []
    if backend.startswith("pack") and object_format(repo) != "sha1":
        hints.append(f"{backend} reads SHA-1 repositories only; git was used.")
        backend = "git"
    if git(repo, "rev-parse", "--is-shallow-repository").strip() == b"true":
        hints.append("The repository is a shallow clone: history before its boundary is unknown.")
    return backend, hints


def resolved(spark: SparkSession, repo: str, base: str, typed: str) -> str:
    """The tracked path that a typed one means: relative to base, absolute, with dots, or a unique end of a tracked path."""
    from ..operators import explain

    if not typed:
        raise UsageError("a path must not be empty")
    full = os.path.normpath(os.path.join(os.path.abspath(base), typed))
    real = os.path.realpath(repo)
    inside = next((os.path.relpath(p, real) for p in (full, os.path.join(os.path.realpath(os.path.dirname(full)), os.path.basename(full))) if p.startswith(real + os.sep)), None)
    for path in filter(None, (inside, explain.same_name(typed))):
        if is_tracked(repo, path):
            return path
    asked = spark.createDataFrame([(explain.same_name(typed),)], "asked string")
    found = explain.resolve(universe(spark, repo), asked).first()
    if found["status"] == "ambiguous":
        raise UsageError(f"{typed!r} is ambiguous: {found['matches']}")
    if found["status"] == "missing":
        raise UsageError(f"{typed!r} is {'not tracked in' if inside else 'outside'} the repository")
    return found["path"]


def exact_renames(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    """ord, old_path, new_path: content that moved whole, from the tree entries that each commit changes."""
    register(spark)
    baskets = history(spark, repo, **options).select("ord", "hash")
    entries = baskets.mapInPandas(lambda pages: _entries(repo, pages), "ord long, parent_ord long, path string, mode int, blob string")
    return renames.exact_content_renames(entries).select((F.col("ord") / 2).cast("long").alias("ord"), "old_path", "new_path")


def _entries(repo: str, pages):
    """Entries that a commit brings in (ord 2n) and those of its parent that it takes away (ord 2n + 1)."""
    import pandas as pd

    for page in pages:
        of, ord_, rows = dict(zip(page["hash"], page["ord"])), None, []
        found = tokens(git_stream(repo, "diff-tree", "--stdin", "--root", "-r", "-z", "--no-renames", "--raw", "--no-abbrev", given="".join(f"{h}\n" for h in page["hash"]).encode()))
        for token in found:
            head = token.decode(errors="replace").split()
            if len(head) == 1 and head[0] in of:
                ord_ = int(of[head[0]])
                continue
            if len(head) != 5 or not head[0].startswith(":"):
                raise LogError(f"unexpected entry {token!r}")
            name = name_of(next(found))
            if head[4] == "A":
                rows.append((2 * ord_, 2 * ord_ + 1, name, int(head[1], 8), head[3]))
            elif head[4] == "D":
                rows.append((2 * ord_ + 1, -1, name, int(head[0][1:], 8), head[2]))
        yield pd.DataFrame(rows, columns=["ord", "parent_ord", "path", "mode", "blob"])
