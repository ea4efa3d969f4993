"""What the whole job reads is written by all tasks that make it."""

import inspect

from tidemark.plans import boundary


def test_envelopes_are_not_made_by_one_task():
    assert "coalesce" not in inspect.getsource(boundary.stream_engine)
