"""End-to-end use of evalspark with your own model (here a toy keyword predictor).

    python examples/quickstart.py /root/testdata/sf0.01

1. corpus (documents + labels) -> exact balanced sample stratified by length group
2. crop reviews, render a prompt, score with a Python predictor (mapInPandas), parse answers
3. evaluate (11 metrics in one aggregate) and log the run to a parquet run log
4. a parameter sweep evaluated per run, a paired comparison of two runs, and run-log analysis
"""

from __future__ import annotations

import os
import sys
import uuid

import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def my_predictor_factory():
    """Build the model once per task; return (prompts, params) -> content / token counts."""
    cues = ("bad", "worst", "boring")

    def predict(prompts: pd.Series, params) -> pd.DataFrame:
        strict = params.get("top_k", 40) > 30
        neg = prompts.str.lower().apply(lambda s: any(c in s for c in (cues if strict else cues[:1])))
        content = neg.map({True: "negative", False: "positive"})
        return pd.DataFrame({"content": content, "prompt_tokens": prompts.str.split().str.len(),
                             "completion_tokens": 1})

    return predict


def main(sf_dir: str) -> None:
    from pyspark.sql import functions as F

    from evalspark.functions.text import crop_middle
    from evalspark.operators import compare, infer, sampling, stats
    from evalspark.operators.metrics import evaluate
    from evalspark.plans import jobs
    from evalspark.session import ensure_checkpoint_dir, local_session
    from evalspark.sources import runlog
    from evalspark.sources.tables import labelled_corpus

    spark = local_session(8)
    corpus = labelled_corpus(spark, sf_dir).withColumn("n_words", F.size(F.split("review", r"\s+")))
    group, _ = stats.size_groups(corpus, "n_words", bins=100, min_count=100)
    corpus = corpus.withColumn("size_group", group)
    sample = sampling.balanced_sample(corpus, "true_label", 20, ["size_group"], seed=42,
                                      columns=["example_id", "review", "true_label"])
    examples = sample.withColumn("review", crop_middle("review", 30, 30))

    template = "Review: {review}\nIs it positive or negative? Answer with one word."
    log_root = os.path.join(ensure_checkpoint_dir(spark), "quickstart-log", uuid.uuid4().hex)
    preds, ev = jobs.run_experiment(spark, examples, my_predictor_factory, template, run_name="keywords",
                                    model_name="toy", params={"top_k": 40}, log_root=log_root,
                                    description="three negative cue words")
    ev.show(vertical=True)

    grid = infer.parameter_grid(top_k=[20, 40])
    sweep_preds, sweep_ev = jobs.sweep(examples, grid, my_predictor_factory, template)
    sweep_ev.select("run_id", "accuracy_score", "precision", "recall", "n").show()
    pairs = compare.paired_comparison(compare.correctness(sweep_preds), [g["run_id"] for g in grid])
    compare.with_required_n(pairs).show()

    wide = runlog.cast_run_columns(runlog.search_runs(runlog.read_run_tables(spark, log_root),
                                                      tag_keys=["mlflow.runName", "description"]))
    wide.select("run_id", "`tags.mlflow.runName`", "`tags.description`", "`metrics.accuracy_score`").show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
