"""Training-data operators: ten whole-corpus jobs and the queries that apply them.

Nothing outside this folder imports it, so the rest of the library works without it.
"""
