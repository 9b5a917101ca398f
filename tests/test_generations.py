"""What was landed before goes once it is landed again."""

from __future__ import annotations

import os

import pytest
from test_records import _companies

from regframe.operators import maintain
from regframe.streaming import landing


def test_a_generation_landed_again_goes(spark, tmp_path):
    directory, root = str(tmp_path / "dump"), str(tmp_path / "raw")
    os.makedirs(directory)
    firms, codes = f"{directory}/K3241.K03200Y0.D60925.EMPRECSV", f"{directory}/F.CNAECSV"

    def land(n):
        _companies(firms, n, name="nome" * n)
        with pytest.warns(UserWarning):
            return landing.land(spark, directory, root, ano_mes="202609")[0]

    _companies(codes, 2)
    one = land(20)
    assert landing.expire_generations(spark, one) == []
    two = land(21)
    assert two.endswith("g=2") and landing.expire_generations(spark, two) == [one]
    assert maintain.list_dirs(spark, root) == ["g=2"] and landing.read_landed(spark, two, "empresas").count() == 21
    os.remove(codes)  # cleared after it was loaded: only the old generation holds it
    three = land(22)
    assert landing.expire_generations(spark, three) == [] and maintain.list_dirs(spark, root) == ["g=2", "g=3"]
