"""Ignore rules against git itself."""

import random
import subprocess

from prosegrid.sources import ignores

RULES = {
    "": ["# comment", "", "*.log", "!keep.log", "/build", "docs/*.txt", "**/cache", "out/**", "a/**/z", "tmp/", "!tmp/kept", "foo*", "!foo.md", "x?y", "[a-c]1", "[!a-c]2", "\\#hash", "trail\\ ", "space ", "*.tmp/"],
    "sub/": ["!*.log", "*.md", "!/build", "deep/"],
    "sub/deep/": ["!never.txt"],
    "a/": ["!z", "b"],
}


def trees(rnd):
    names = ["keep.log", "x.log", "build", "docs", "a.txt", "cache", "out", "z", "tmp", "kept", "foo.md", "food", "xxy", "a1", "d2", "a2", "#hash", "trail ", "space", "sub", "deep", "never.txt", "a", "b", "n.md", "q.tmp"]
    files, folders = set(), set()
    for _ in range(400):
        parts = [rnd.choice(names) for _ in range(rnd.randint(1, 4))]
        above = ["/".join(parts[:k]) for k in range(1, len(parts))]
        path = "/".join(parts)
        if path not in folders and not files & set(above):
            files.add(path)
            folders |= set(above)
    return sorted(files)


def test_against_git(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    files = trees(random.Random(4))
    for path in files:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("")
    texts = [(f"{folder}.gitignore", "\n".join(lines) + "\n") for folder, lines in RULES.items() if not folder or (tmp_path / folder).is_dir()]
    for path, text in texts:
        (tmp_path / path).write_text(text)
    told = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(files), capture_output=True, text=True)
    expected = {p for p in told.stdout.split("\0") if p}
    rules = ignores.rules_of(spark.createDataFrame(texts, "path string, text string"))
    rows = ignores.left_out(spark.createDataFrame([(p,) for p in files], "path string"), rules).collect()
    assert len(rows) == len(files) and 50 < len(expected) < len(files) - 20
    assert {r.path for r in rows if r.ignored} == expected


def test_walk(spark, tmp_path):
    from prosegrid.sources import files

    for path, text in ((".gitignore", "*.tmp\nbuild/\n"), ("a.md", "x"), ("b.tmp", "x"), ("build/c.md", "x"), ("sub/.ignore", "d.md\n!e.tmp\n"), ("sub/d.md", "x"), ("sub/e.tmp", "x"), (".git/f.md", "x")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    walked = lambda **more: sorted(r.path for r in files.walk(spark, str(tmp_path), ["**/*.md", "**/*.tmp"], [], **more).collect())
    assert walked() == ["a.md", "sub/e.tmp"]
    assert walked(ignores=False) == ["a.md", "b.tmp", "build/c.md", "sub/d.md", "sub/e.tmp"]
