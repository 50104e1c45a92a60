"""Training-data operators: text, URL, archive, tokenizer and near-duplicate jobs on Spark."""
