"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general DataFrame-in / DataFrame-out interface; ``queries`` registers
the thin per-contract queries built on them.
"""
