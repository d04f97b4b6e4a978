"""The driver's contract, with and without the training-data subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_without_the_training_data_operators():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['strandline', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not [n for n in e.queries() if n.startswith('op1_') or n == 'pipeline']
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
