"""Few-shot instruction data and scoring of model answers as Spark jobs."""

from shotweave.operators.balance import class_stats, oversample_minority
from shotweave.operators.bpe import (
    Tokenizer, bpe_decode, bpe_encode, bpe_train, tokenizer_stats, word_counts,
)
from shotweave.operators.cleaning import (
    coerce_label, coerce_numeric, dedup_keep_first, drop_missing, has_min_rows, keep_large_tasks,
    sample_exact, sample_fraction, with_canonical_key,
)
from shotweave.operators.masking import mask_token
from shotweave.operators.merge import merge_shuffle
from shotweave.operators.metrics import (
    accuracy, evaluate_classification, evaluate_regression, pr_auc, r2, rmse, roc_auc,
)
from shotweave.operators.scoring import (
    ModelFactory, finite_only, invalid_count, predict, resolve_label, resolve_value, with_true_label,
    with_true_value,
)
from shotweave.operators.sft import pad_batches, sft_concat, sft_padded
from shotweave.operators.shots import (
    apply_shortfall, pool_rows, random_shots, select_shots, shots_array,
)
from shotweave.operators.similarity import build_index, candidate_pool, knn, neighbour_rows
from shotweave.operators.split import group_split, with_group_key
from shotweave.plans.records import (
    Masking, RecordConfig, build_classification, build_classification_tasks, build_regression,
    build_regression_tasks, prepare_classification, prepare_classification_tasks, value_range,
    value_range_by_task,
)
from shotweave.plans.scoring import score, scoring_prompts
from shotweave.sources.records import (
    read_record_lines, read_records, write_metrics, write_records, write_results,
)
from shotweave.sources.tables import read_corpus, read_task
from shotweave.sources.tokenizers import load_tokenizer, save_tokenizer, save_tokenizer_files
