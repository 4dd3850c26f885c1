"""The corpus pipeline as a query; None of it is here but the call."""

from __future__ import annotations


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
