"""DataFrame operators: lazy, and free of collects unless their text says otherwise."""
