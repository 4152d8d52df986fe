"""Entry points composed of operators: metric registry, SQL gate, dashboard board."""
