"""Schemas of the observation records, as DDL. Nothing is inferred from data."""

SOURCE = "struct<provider: string, transport: string, endpoint: string>"
UTXO = "struct<txid: string, vout: bigint, value_sats: bigint, confirmed_height: bigint, confirmed_at: timestamp>"
TX_INPUT = f"struct<txid: string, vout: bigint, sequence: bigint, prev_out_value_sats: bigint, prev_out_address: string, is_coinbase: boolean, historical_utxo: {UTXO}>"
TX_OUTPUT = "struct<value_sats: bigint, n: bigint, script_pubkey_type: string, address: string, scriptpubkey_hex: string>"
BLOCKS = f"block_hash string, height bigint, timestamp timestamp, previous_block_hash string, tx_count bigint, size_bytes bigint, weight bigint, difficulty double, miner_tag string, interval_seconds bigint, source {SOURCE}"
TRANSACTIONS = (
    "txid string, timestamp timestamp, block_hash string, block_height bigint, fee_sats bigint, size bigint, weight bigint, vsize bigint, fee_rate_sat_vb double, total_input_sats bigint, "
    f"total_output_sats bigint, input_count bigint, output_count bigint, inputs array<{TX_INPUT}>, outputs array<{TX_OUTPUT}>, is_rbf boolean, confirmed boolean, source {SOURCE}"
)
REPLACEMENTS = f"replaced_txids array<string>, replacement_txid string, old_fee_sats bigint, new_fee_sats bigint, fee_delta_sats bigint, old_vsize bigint, new_vsize bigint, observed_at timestamp, source {SOURCE}"
REORGS = f"old_tip_hash string, old_tip_height bigint, new_tip_hash string, new_tip_height bigint, common_ancestor_hash string, depth bigint, disconnected_blocks array<string>, connected_blocks array<string>, observed_at timestamp, source {SOURCE}"
MEMPOOL = f"count bigint, vsize_bytes bigint, total_fee_sats bigint, min_fee_rate_sat_vb double, timestamp timestamp, source {SOURCE}"
BY_TYPE = {"block": BLOCKS, "transaction": TRANSACTIONS, "replacement": REPLACEMENTS, "reorg": REORGS, "mempool": MEMPOOL}
