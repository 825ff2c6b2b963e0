"""The subpackage out of a zip, and without a library that it needs."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ran(code: str, path: str) -> str:
    env = os.environ | {"PYTHONPATH": path, "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd="/", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


def test_models_load_from_a_zip(tmp_path):
    shutil.copytree(f"{ROOT}/lorebase", tmp_path / "tree/lorebase", ignore=shutil.ignore_patterns("__pycache__"))
    package = shutil.make_archive(str(tmp_path / "package"), "zip", tmp_path / "tree")
    code = """
import lorebase
assert '.zip' in lorebase.__file__
from lorebase.llm import abuse, personal
network, threshold = abuse.load()
print([s >= threshold for s in network.score(['You are a worthless idiot and I will hurt you.', 'The cache is warm.', None])])
print(sorted({k for _, _, k in personal.Detector()('Please contact Ngozi Okafor, ngozi@a.example')}))
"""
    assert ran(code, package).split("\n")[:2] == ["[True, False, False]", "['email', 'name']"]


def test_queries_without_a_library():
    code = """
import sys
sys.modules['xxhash'] = None
import __spark_entry__ as e
names = set(e.queries())
print(len(names) > 80, any(n.startswith('p1_') for n in names), set(e.oracle_sql()) <= names)
"""
    assert ran(code, ROOT).split() == ["True", "False", "True"]
