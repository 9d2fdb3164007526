"""A corpus pipeline of five stages; each reads what its predecessor wrote.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from arcweft.llm import mixing, packing, pii, simhash, toxicity
from arcweft.llm.common import checkpoint, table


def drop_toxic(spark, docs, sf_dir):
    """Operator 9: documents predicted toxic go.  An unlabelled corpus loses none."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    """Operator 7: of each group of near-duplicates (five words, similarity 0.8) the least doc_id stays."""
    return simhash.without_near_duplicates(docs)


def pseudonymise(spark, docs, sf_dir):
    """Operator 6: personal data gets format-preserving pseudonyms; n_chars is counted anew."""
    return pii.without_pii(docs, pii.session_key(spark))


def mix_sources(spark, docs, sf_dir):
    """Operator 1: sources at their target weights; a document that is sent twice is there twice."""
    return mixing.mix_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """Operator 5: places of all pieces in sequences; copies of a document never share one."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned scores nor the packing; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each stage's rows cut off from the plan before by a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
