"""Training-data operators. Nothing outside this folder and the pipeline imports them."""
