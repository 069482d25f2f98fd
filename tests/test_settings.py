import pytest

from terrakey.functions.settings import overridden


def test_overrides_keep_types():
    base = {"clip": 2.0, "limit": 2048, "shadows": True, "method": "magsac"}
    got = overridden(base, ["clip=3", "limit=10", "shadows=No", "method=a=b", "limit=11"])
    assert got == {"clip": 3.0, "limit": 11, "shadows": False, "method": "a=b"} and isinstance(got["clip"], float)
    assert overridden(base, ["shadows=YES"])["shadows"] is True and overridden(base, []) == base and base["limit"] == 2048
    for bad in ("none=1", "limit", "limit=x"):
        with pytest.raises(ValueError):
            overridden(base, [bad])
