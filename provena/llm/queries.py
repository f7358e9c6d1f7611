"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from provena.llm import decontam, htmltext, linededup, minhash, packing, pii, quality, tokenfile, toxicity, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_minhash_near_dedup": minhash.op2_minhash_near_dedup,
        "op3_personal_data": pii.op3_personal_data,
        "op4_benchmark_decontamination": decontam.op4_benchmark_decontamination,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_token_files": tokenfile.op6_token_files,
        "op7_html_main_text": htmltext.op7_html_main_text,
        "op8_warc_revisits": warc.op8_warc_revisits,
        "op9_toxicity_chain": toxicity.op9_toxicity_chain,
        "op10_quality_rules": quality.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": minhash.OP2_SQL, "op5_line_dedup": linededup.OP5_SQL, "op8_warc_revisits": warc.OP8_SQL}
