"""Training-data operators: packing, language, neighbours, duplicates, labels, licences, chat, secrets, leaks."""
