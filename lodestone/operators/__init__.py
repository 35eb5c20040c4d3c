"""Operators over long tables: runs, judgments, postings, codes and vectors.

A run is (qid, docid, score), judgments are (qid, docid, rel), term sets are
(docid, term), sparse vectors (id, term, weight), codes (docid, codes), edges of
a trie (prefix, next) and a codebook (m, code, vec). Every function takes and
returns DataFrames and is lazy.
"""
