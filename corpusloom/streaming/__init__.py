"""The training loader and the file-stream reader."""
