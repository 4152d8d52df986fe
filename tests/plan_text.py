"""The text of a physical plan."""

import contextlib
import io


def plan(df, mode=None):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode) if mode else df.explain()
    return out.getvalue()
