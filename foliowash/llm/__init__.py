"""Training-data operators: classifiers, packing, scoring, search, de-duplication, output and mixing.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it, so it can be deleted whole.
"""
