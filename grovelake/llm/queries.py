"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from . import embeddings, htmltext, langid, mixing, packing, pii, quality, sharding, simhash, suffix


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_html": htmltext.op2_html,
        "op3_quality": quality.op3_quality,
        "op4_suffix": suffix.op4_suffix,
        "op5_simhash": simhash.op5_simhash,
        "op6_embeddings": embeddings.op6_embeddings,
        "op7_packing": packing.op7_packing,
        "op8_pii": pii.op8_pii,
        "op9_mixing": mixing.op9_mixing,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict:
    return {"op10_sharding": sharding.ORACLE}
