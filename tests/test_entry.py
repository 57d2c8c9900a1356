import subprocess
import sys

import __spark_entry__ as entry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_needs_the_optional_package():
    code = "import sys; sys.modules['palimpsest.llm'] = None\nfrom palimpsest.plans import registry\nfrom palimpsest.streaming import ingest\nfrom palimpsest.sources import artifacts\nassert not any(m.startswith('palimpsest.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
