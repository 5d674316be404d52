"""lamella: a PySpark-native engine for cryo-electron-tomography tables and volumes."""
