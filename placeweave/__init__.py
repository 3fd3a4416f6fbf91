"""placeweave: Vietnamese administrative addresses, converted by Spark plans."""
