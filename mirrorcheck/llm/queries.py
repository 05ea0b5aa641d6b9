"""The registered queries of the text operators and, where SQL can say it, the SQL they are checked against."""

from __future__ import annotations

from . import sql
from .common import table
from .decontaminate import contamination_table, near_table
from .hilbert import neighbour_table
from .hyperplanes import near_vector_table
from .jaccard import component_table
from .licenses import license_table
from .merkle import manifest_table
from .mixing import mix_table
from .resampling import resampling_table
from .secrets import secret_table
from .sharding import shard_table
from .surrogates import surrogate_table
from .token_blocks import token_table
from .toxicity import toxicity_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


QUERIES = {
    "op1_token_blocks": lambda spark, sf_dir: token_table(table(spark, sf_dir, "documents"), tokenizer_path()),
    "op2_positional_index": lambda spark, sf_dir: contamination_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_positional_index_near": lambda spark, sf_dir: near_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op3_surrogates": lambda spark, sf_dir: surrogate_table(table(spark, sf_dir, "documents")),
    "op4_temperature_mixing": lambda spark, sf_dir: mix_table(table(spark, sf_dir, "documents")),
    "op5_subword_softmax": lambda spark, sf_dir: toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_combination_prefixes": lambda spark, sf_dir: component_table(table(spark, sf_dir, "documents")),
    "op7_hilbert_windows": lambda spark, sf_dir: neighbour_table(table(spark, sf_dir, "embeddings")),
    "op8_secret_ownership": lambda spark, sf_dir: secret_table(table(spark, sf_dir, "documents")),
    "op9_rendezvous_shards": lambda spark, sf_dir: shard_table(table(spark, sf_dir, "documents")),
    "op10_license_blocks": lambda spark, sf_dir: license_table(table(spark, sf_dir, "documents")),
    "op11_nested_intervals": lambda spark, sf_dir: manifest_table(table(spark, sf_dir, "documents")),
    "op12_importance_resampling": lambda spark, sf_dir: resampling_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op13_sign_hashing": lambda spark, sf_dir: near_vector_table(table(spark, sf_dir, "embeddings")),
}

SQL: dict[str, str] = {
    "op2_positional_index": sql.CONTAMINATION,
    "op6_combination_prefixes": sql.COMPONENTS,
    "op8_secret_ownership": sql.SECRETS,
    "op9_rendezvous_shards": sql.SHARDS,
    "op10_license_blocks": sql.LICENSES,
    "op11_nested_intervals": sql.MANIFEST,
    "op12_importance_resampling": sql.RESAMPLING,
    "op13_sign_hashing": sql.NEAR_VECTORS,
}
