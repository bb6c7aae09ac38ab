"""The public names of the library in one place.

Functions of a column return a column, functions of a table a DataFrame; a
tokenizer's own methods (``tokenize``, ``encode``, ``decode``, ``token_to_id``,
``id_to_token``, ``vocab_size``, ``special_tokens``, ``model_info``, ``unk_id``,
``pad_id``, ``bos_id``, ``eos_id``) are for single texts and ids.
"""

from .functions.normalizers import word_split
from .functions.spans import (
    assert_offsets_contract,
    has_nonempty_span,
    has_span,
    is_valid_string_boundary,
    offsets_are_nonoverlapping,
    offsets_coordinate_system,
    offsets_index_base,
    offsets_sentinel,
    offsets_span_style,
    span_codeunits,
    span_ncodeunits,
    span_substrings,
    try_span_substring,
    validate_offsets_contract,
)
from .operators.batches import (
    causal_labels_long,
    causal_lm_labels,
    collate_padded_batch,
    pack_blocks,
    packed_ids,
    quick_causal_lm_batch,
    span_to_tokens,
    subword_to_word,
    word_offsets,
)
from .operators.encode import (
    as_callable,
    count_by_words,
    count_tokens,
    decode,
    encode,
    encode_batch_result,
    encode_result,
    level_key,
    normalize_text,
    normalized,
    quick_encode_batch,
    quick_tokenize,
    register,
    requires_tokenizer_normalization,
    tokenization_view,
    tokenize,
    tokens_long,
    word_tokens,
)
from .operators.models import BPE, ByteBPE, SentencePiece, Tiktoken, Tokenizer, Unigram, WordPiece
from .operators.pipeline_json import FormatError, Pipeline
from .operators.training import (
    TrainingConfig,
    TrainingResult,
    train_bpe,
    train_bpe_result,
    train_bytebpe,
    train_bytebpe_result,
    train_hf_bert_wordpiece,
    train_hf_bert_wordpiece_result,
    train_hf_gpt2_bytebpe,
    train_hf_gpt2_bytebpe_result,
    train_hf_roberta_bytebpe,
    train_hf_roberta_bytebpe_result,
    train_sentencepiece,
    train_sentencepiece_result,
    train_unigram,
    train_unigram_result,
    train_wordpiece,
    train_wordpiece_result,
    word_counts,
)
from .operators.vocabulary import Vocabulary, lookup_ids, lookup_tokens, special_mask, special_roles, vocabulary_frame, without_skipped
from .sources.bundles import load_training_bundle, quick_train_bundle, read_training_manifest, save_training_bundle, write_training_manifest
from .sources.files import (
    FilesSpec,
    cached_tokenizers,
    clear_tokenizer_cache,
    detect_tokenizer_files,
    detect_tokenizer_format,
    export_hf_tokenizer_json,
    export_tokenizer,
    get_tokenizer_cached,
    load_bpe,
    load_bpe_encoder,
    load_bpe_gpt2,
    load_bytebpe,
    load_hf_tokenizer_json,
    load_sentencepiece,
    load_tiktoken,
    load_tokenizer,
    load_unigram,
    load_wordpiece,
    save_tokenizer,
)
from .sources.registry import (
    asset_status,
    available_models,
    describe_model,
    download_hf_files,
    filter_models,
    install_llama2_tokenizer,
    install_llama3_8b_tokenizer,
    install_model,
    model_path,
    models_frame,
    prefetch_models,
    prefetch_models_status,
    print_asset_status,
    recommended_defaults_for_llms,
    register_external_model,
    register_local_model,
)
from .streaming.encode import encode_stream, read_texts, token_rates

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("functions", "operators", "sources", "streaming")]
