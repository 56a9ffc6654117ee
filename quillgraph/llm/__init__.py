"""Training-data operators: packing, byte-level BPE, quality rules, HTML text,
substring and near-duplicate removal, pseudonyms, fingerprints, toxicity, a
positive-unlabelled quality classifier, Merkle manifests, repeated bytes by
suffix arrays and periodic runs.  Nothing else in the library imports
this subpackage; it may be deleted together with ``corpus_pipeline.py``."""
