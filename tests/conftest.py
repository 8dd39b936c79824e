import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
# Python workers unpickle functions defined in test modules by reference
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.dirname(os.path.abspath(__file__))] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

GOLDEN = os.path.join(os.path.dirname(os.path.abspath(__file__)), "golden")


@pytest.fixture(scope="session")
def spark():
    from qtemplates.session import get_spark
    d = tempfile.mkdtemp(prefix="qt-tests-")
    s = get_spark("local[4]", 4, extra={"spark.checkpoint.dir": os.path.join(d, "ckpt"),
                                        "spark.local.dir": os.path.join(d, "local")})
    yield s
    s.stop()


def golden(name: str):
    import csv
    with open(os.path.join(GOLDEN, name), newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))
