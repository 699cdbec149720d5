"""The entry leaves out what can't be imported, and says so unless its folder is missing."""

import sys
import warnings

import pytest

import __spark_entry__ as entry


def test_missing_folder_is_left_out_silently():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert entry._optional("no_such_module") is None


def test_missing_library_is_named(tmp_path, monkeypatch):
    (tmp_path / "needs_a_library.py").write_text("import no_such_library\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="no_such_library"):
        assert entry._optional("needs_a_library") is None
    assert "needs_a_library" not in sys.modules
