"""Renames against git's own, on a made repository."""

import random
import subprocess

from graphloom.operators import renames
from graphloom.sources import git


def made(rnd, n):
    return "".join(f"line {rnd.randrange(10**6)} of {k} {'x' * rnd.randrange(90)}\n" for k in range(n))


def test_pairs_are_those_of_git(spark, tmp_path):
    rnd, old, new = random.Random(5), {}, {}
    for k in range(14):
        text = made(rnd, rnd.randrange(8, 60))
        old[f"src/a{k}.py"] = text
        lines = text.splitlines(keepends=True)
        for at in rnd.sample(range(len(lines)), len(lines) * (k * 6) // 100):
            lines[at] = f"other {rnd.random()}\n"
        new[f"lib/{'sub/' if k % 2 else ''}{'a' if k % 3 else 'b'}{k}.py"] = "".join(lines) + made(rnd, k // 4)
    old["gone.py"], new["fresh.py"], old["same.txt"], new["moved/same.txt"] = made(rnd, 30), made(rnd, 30), "the same\n" * 9, "the same\n" * 9
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    for files, other in ((old, {}), (new, old)):
        for p in other:
            (tmp_path / p).unlink()
        for p, t in files.items():
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p).write_text(t)
        run("add", "-A")
        run("commit", "-qm", "x")
    said = run("diff", "--name-status", "-M50%", "HEAD~1", "HEAD")
    want = {(r.old_path, r.path) for r in git.name_status(git.lines(spark, said), renames_as_modified=False).collect() if r.change_type == "renamed"}
    frame = lambda files: spark.createDataFrame([(p, t.encode()) for p, t in files.items()], "path string, content binary")
    got = {(r.old, r.new) for r in renames.renames(frame(old), frame(new)).collect()}
    assert got == want and 6 < len(want) < 15
    plain = spark.createDataFrame([(p, "deleted", None) for p in old] + [(p, "added", None) for p in new], "path string, change_type string, old_path string")
    out = renames.with_renames(plain, frame(old), frame(new)).collect()
    assert {(r.old_path, r.path) for r in out if r.change_type == "renamed"} == want and len(out) == len(old) + len(new) - len(want)
