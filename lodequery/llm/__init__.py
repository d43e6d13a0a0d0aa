"""Training-data operators: scoring, filtering, scanning, joining and packing of documents."""
