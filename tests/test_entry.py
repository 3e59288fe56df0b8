"""The entry module with and without what the corpus queries need."""

import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = """
import json, sys, warnings
blocked = sys.argv[1:]
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name in blocked:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Blocked())
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    import __spark_entry__
print(json.dumps([sorted(__spark_entry__.queries()), sorted(__spark_entry__.oracle_sql()), [str(w.message) for w in seen if "corpus" in str(w.message)]]))
"""


def listed(*blocked):
    done = subprocess.run([sys.executable, "-c", LISTED, *blocked], cwd=ROOT, capture_output=True, text=True, check=True)
    return json.loads(done.stdout.splitlines()[-1])


def test_entry_without_a_library_or_the_corpus_operators():
    from learntrace.plans import catalogue

    for missing in ("learntrace.llm", "corpus_pipeline", "ahocorasick"):
        queries, oracles, told = listed(missing)
        assert queries == sorted(catalogue.QUERIES) and oracles == sorted(catalogue.ORACLES) and len(told) == 1


def test_oracles_belong_to_queries():
    queries, oracles, _ = listed()
    assert set(catalogue_names()) <= set(queries) and set(oracles) <= set(queries)


def catalogue_names():
    from learntrace.plans import catalogue

    return catalogue.QUERIES
