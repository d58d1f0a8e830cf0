"""The registered queries of the training-data operators, and SQL twins where SQL can express them."""

from floodsight.llm.bit_pack import op2_token_output
from floodsight.llm.chat import OP8_SQL, op8_chat_format
from floodsight.llm.decontaminate import op1_decontamination
from floodsight.llm.language import op3_language_id
from floodsight.llm.line_crf import op4_line_quality
from floodsight.llm.line_dedup import op10_line_dedup
from floodsight.llm.mixing import OP7_SQL, op7_mixing
from floodsight.llm.ngram_join import op9_ngram_jaccard
from floodsight.llm.permuterm import OP13_SQL, op13_spelling_variants
from floodsight.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from floodsight.llm.pseudo_likelihood import op6_pseudo_likelihood
from floodsight.llm.repeats import op5_repeated_passages
from floodsight.llm.slots import OP12_SQL, op12_sharding

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_token_output,
        op3_language_id,
        op4_line_quality,
        op5_repeated_passages,
        op6_pseudo_likelihood,
        op7_mixing,
        op8_chat_format,
        op9_ngram_jaccard,
        op10_line_dedup,
        op11_prefix_trie,
        op12_sharding,
        op13_spelling_variants,
    )
}
SQL = {
    "op7_mixing": OP7_SQL,
    "op8_chat_format": OP8_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_sharding": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
