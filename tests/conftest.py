from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from regframe.session import build_session

    s = build_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="regframe-test-")


@pytest.fixture(scope="session")
def mini_base(spark, scratch):
    """The mini dump loaded once: (base_root, summary, dimension csv paths)."""
    import mini_fixture
    from regframe.operators import load
    from regframe.sources import dims

    dump_dir = mini_fixture.write_dump(os.path.join(scratch, "dump"))
    mcsv, ccsv = mini_fixture.write_dimensions(os.path.join(scratch, "dims"))
    base = os.path.join(scratch, "base")
    summary = load.load_dump(
        spark,
        dump_dir,
        base,
        municipio_ibge=dims.municipalities_from_csv(spark, mcsv),
        cnae_classes=dims.activity_classes_from_csv(spark, ccsv),
        partitions=2,
    )
    return base, summary, (mcsv, ccsv)


@pytest.fixture(scope="session")
def mini_reg(spark, mini_base):
    from regframe.operators import load

    return load.open_base(spark, mini_base[0])
