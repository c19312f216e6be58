"""From a table of documents to packed training sequences, in five stages.

Every stage works on all rows its predecessor kept. All but the last return the
columns of ``documents``.
"""

from taxaspark.llm import decontaminate, exact, near, pack, toxicity
from taxaspark.llm.tables import materialize, table


def drop_toxic(spark, docs, sf_dir):
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the one with the largest doc_id stays."""
    return exact.drop_copies(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """Of documents linked by a similarity of 0.8 or more over five-word shingles, the one with the smallest doc_id stays."""
    return near.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a benchmark item or a paraphrase of one go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark, docs, sf_dir):
    """The rest is packed into sequences of 1024 tokens; workers already hold the memory of four stages, so they remember fewer pieces."""
    return pack.pack(docs, kept_pieces=100_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# Learned scores, iterated components, a decomposition and a tokenizer: no SQL says them.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each result written as a table and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
